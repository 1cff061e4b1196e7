"""Language-model scores from an n-gram trie in Elias-Fano form.

All texts are tokenized (byte-level BPE) and their trigrams counted, whole
corpus, nothing pruned. Probabilities are Kneser-Ney, interpolated, with one
discount; the order is 3. The trie is one of contexts, read backwards: the last
token before the predicted one stands first. Its upper level has every token's
successors, its lower level hangs from it: links lead from a token to the tokens
before it, monotone pointers from such a pair to its successors, and these are
numbers relative to the upper level's: places in the list of that token's
successors. All are Elias-Fano; log probabilities are quantised to 16 bits. A
trigram is found by successor search within the upper context's range, and then
for the place found there within the lower one's.

Tokens are dealt to groups by how often they occur; a group is a run of rarer
tokens or one frequent token, whose pairs are dealt to several shards by the
token before. A task packs its documents into chunks; a chunk's distinct trigrams
with their counts travel to their shards, once. There the trie's files, which
tasks map into memory, are built, each distinct trigram is looked up once, and
the results go back to the chunks by a join. So no task opens more than one shard,
and neither texts nor their tokens are ever shuffled: their table is bucketed.

spark.checkpoint.dir must be on a file system that executors mount.

Defined results: a null text has null figures, a text without tokens 0 tokens
and null figures; both count nothing. Repeated rows are counted and scored each;
null ids are carried; an empty table gives an empty result. Other columns,
whatever their names, are ignored. A vocabulary of more than TOP - 2 ids is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import bpe
from pathloom.llm.common import field, local_path, materialize, materialize_by, name_of, shared_dir, table, tidied
from pathloom.llm.ef import EliasFano
from pathloom.llm.op02_tokens import lister

#: Bits of a token in a key; the begin and the end of a text come before the vocabulary's ids.
BITS = 21
TOP = 1 << BITS
BEGIN, END, SHIFT = 0, 1, 2
DISCOUNT = 0.75
#: Tokens of a chunk, and trigrams of a shard, about.
CHUNK_TOKENS = 2_000_000
SHARD_TOKENS = 4_000_000
#: Chunks lie in a bucketed table, a bucket for so many bytes of text, so that they need no shuffle to meet their answers.
TABLE_BYTES = 16 << 20
#: Log probabilities are kept in steps of 1/QUANT, down to -65535/QUANT.
QUANT = 1024
LOW = np.uint64(TOP - 1)
B = np.uint64(BITS)


def quantised(log_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log_p * -QUANT), 0, 65535).astype(np.uint16)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight lie together, which packs better."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(raw: np.ndarray | bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def packed(x: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(_planes(x))


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    return _from_planes(zstandard.ZstdDecompressor().decompress(blob), kind)


def squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts as one blob: differences, like bytes together."""
    import zstandard

    step = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(_planes(step) + _planes(counts.astype(np.uint64)))


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    half = len(raw) // 2
    return np.cumsum(_from_planes(raw[:half], np.uint64), dtype=np.uint64), _from_planes(raw[half:], np.uint64).astype(np.int64)


def trigrams(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (middle, first, last token) of the trigrams of token lists that are not
    empty, and the list of each. flat: ids plus SHIFT; size: of each list, less than 1 for none."""
    on = np.flatnonzero(size > 0)
    size = size[on]
    seq = np.full(len(flat) + 3 * len(on), BEGIN, np.uint64)
    start = np.cumsum(size + 3) - size - 3
    place = np.arange(len(flat)) + np.repeat(3 * np.arange(len(on)) + 2, size)
    seq[place] = flat
    seq[start + size + 2] = END
    event = np.arange(len(flat) + len(on)) + np.repeat(2 * np.arange(len(on)) + 2, size + 1)
    return (seq[event - 1] << (B + B)) | (seq[event - 2] << B) | seq[event], np.repeat(on, size + 1)


class Shards:
    """Where trigrams go: group of each token, first shard and number of shards of each group."""

    def __init__(self, histogram: np.ndarray, shard_tokens: int):
        """histogram: how often each token is the middle one of a trigram."""
        hot = histogram > shard_tokens
        # runs of the others: a new one where their sum passes a multiple of shard_tokens or a hot token stands
        run = np.cumsum(np.where(hot, 0, histogram)) // max(1, shard_tokens)
        edge = np.concatenate([[False], (run[1:] != run[:-1]) | hot[1:] | hot[:-1]])
        self.group = np.cumsum(edge)
        weight = np.bincount(self.group, histogram)
        self.split = np.maximum(1, np.ceil(weight / max(1, shard_tokens))).astype(np.int64)
        # a run is never split: it may exceed shard_tokens by less than one more
        lone = np.bincount(self.group, hot) > 0
        self.split = np.where(lone, self.split, 1)
        self.first = np.cumsum(self.split) - self.split
        self.n = int(self.split.sum())
        self.group_of = np.repeat(np.arange(len(self.split)), self.split)

    def of(self, keys: np.ndarray) -> np.ndarray:
        g = self.group[(keys >> (B + B)).astype(np.int64)]
        x = ((keys >> B) & LOW) * np.uint64(0x9E3779B97F4A7C15)
        return self.first[g] + ((x >> np.uint64(32)) % self.split[g].astype(np.uint64)).astype(np.int64)

    def deal(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys by shard, and where each shard begins in it."""
        shard = self.of(keys)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(self.n + 1))


class Level:
    """One shard of a level: contexts, pointers, successors, and per successor the
    discounted log probability, per context the log of its total. links: where the
    contexts of each context of the level above begin."""

    def __init__(self, parts: list[EliasFano], probs: np.ndarray, totals: np.ndarray):
        self.parts, self.probs, self.totals = parts, probs, totals
        self.contexts, self.pointers, self.successors = parts[:3]
        self.links = parts[3] if len(parts) > 3 else None

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, counts: np.ndarray, above: int | None = None) -> Level:
        """Events in order of (context, successor), all distinct. With a level above,
        a context is its context there << BITS | a token."""
        edge = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        rank = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(context))))
        total = np.add.reduceat(counts, edge)
        parts = [EliasFano.build(context[edge]), EliasFano.build(np.append(edge, len(context))), EliasFano.build((rank.astype(np.uint64) << B) | successor.astype(np.uint64))]
        if above is not None:
            parts.append(EliasFano.build(np.searchsorted(context[edge] >> B, np.arange(above + 1, dtype=np.uint64))))
        return cls(parts, quantised(np.log((counts - DISCOUNT) / total[rank])), quantised(-np.log(total)))

    def save(self, path: str) -> None:
        arrays = [getattr(e, p) for e in self.parts for p in EliasFano.PARTS] + [self.probs, self.totals]
        head = np.array([len(self.parts)] + [x for e in self.parts for x in (e.n, e.width)] + [len(a) for a in arrays], np.int64)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}"
        with open(part, "wb") as f:
            f.write(head.tobytes())
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
        os.replace(part, path)  # a repeated task writes the same bytes

    @classmethod
    def load(cls, path: str) -> Level:
        raw = np.memmap(path, np.uint8, "r")
        k = int(raw[:8].view(np.int64)[0])
        ends = 1 + 2 * k + 3 * k + 2
        head = raw[: 8 * ends].view(np.int64)
        at, arrays = 8 * ends, []
        for size, kind in zip(head[1 + 2 * k :].tolist(), [np.uint64, np.uint64, np.uint32] * k + [np.uint16, np.uint16]):
            n = size * np.dtype(kind).itemsize
            arrays.append(raw[at : at + n].view(kind))
            at += n + -n % 8
        return cls([EliasFano(int(head[1 + 2 * i]), int(head[2 + 2 * i]), *arrays[3 * i : 3 * i + 3]) for i in range(k)], *arrays[3 * k :])

    def find(self, context: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each context its rank (-1 if unseen), range of successors, and weight of the lower order (1 if unseen)."""
        rank = self.contexts.find(context, lo, hi)
        first, last, lower = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.ones(len(rank))
        seen = np.flatnonzero(rank >= 0)
        if len(seen):
            a, b = self.pointers.access_two(rank[seen])
            first[seen], last[seen] = a.astype(np.int64), b.astype(np.int64)
            lower[seen] = np.minimum(1.0, DISCOUNT * (last[seen] - first[seen]) / np.exp(self.totals[rank[seen]] / QUANT))
        return rank, first, last, lower

    def successor(self, rank: np.ndarray, first: np.ndarray, last: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of a successor among all, -1 where it isn't in the range, and its discounted probability."""
        at = np.full(len(rank), -1, np.int64)
        p = np.zeros(len(rank))
        on = np.flatnonzero((rank >= 0) & (which >= 0))
        if len(on):
            at[on] = self.successors.find((rank[on].astype(np.uint64) << B) | which[on].astype(np.uint64), first[on], last[on])
            got = on[at[on] >= 0]
            p[got] = np.exp(self.probs[at[got]].astype(np.float64) / -QUANT)
        return at, p


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of equals, and the run of each."""
    new = np.concatenate([[True], x[1:] != x[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def look_up(upper: Level, lower: Level | None, unigrams: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Natural log probabilities of keys, in order, of one shard."""
    middle, before, last = keys >> (B + B), (keys >> B) & LOW, (keys & LOW).astype(np.int64)
    one, of = _runs(middle)  # a context's keys stand together: it is looked up once
    rank, first, end, weight = (x[of] for x in upper.find(middle[one]))
    at, p2 = upper.successor(rank, first, end, last)
    low = p2 + weight * unigrams[last]
    if lower is None:
        return np.log(low)
    place = np.where(at >= 0, at - first, -1)
    one, of = _runs(keys >> B)
    r, seen = rank[one], np.flatnonzero(rank[one] >= 0)
    found = [np.full(len(one), -1, np.int64), np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), np.ones(len(one))]
    if len(seen):
        a, b = lower.links.access_two(r[seen])
        got = lower.find((r[seen].astype(np.uint64) << B) | before[one][seen], a.astype(np.int64), b.astype(np.int64))
        for x, y in zip(found, got):
            x[seen] = y
    rank3, first3, end3, weight3 = (x[of] for x in found)
    return np.log(lower.successor(rank3, first3, end3, place)[1] + weight3 * low)


class Model:
    """The trie in a folder."""

    def __init__(self, path: str, shards: Shards, unigrams: np.ndarray):
        self.path, self.shards, self.unigrams = path, shards, unigrams

    def upper(self, group: int) -> Level | None:
        path = f"{self.path}/2/{group}"
        return Level.load(path) if os.path.exists(path) else None

    def lower(self, shard: int) -> Level | None:
        path = f"{self.path}/3/{shard}"
        return Level.load(path) if os.path.exists(path) else None

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithms for keys of any shards, each looked up once."""
        u, back = np.unique(keys, return_inverse=True)
        order, edge = self.shards.deal(u)
        out = np.log(self.unigrams[(u & LOW).astype(np.int64)])
        for s in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[s] : edge[s + 1]]
            upper = self.upper(int(self.shards.group_of[s]))
            if upper is not None:
                out[at] = look_up(upper, self.lower(s), self.unigrams, u[at])
        return out[back]


def pack(df: DataFrame, key: str, text: str, vocabulary: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A row for each chunk: chunk, keys, sizes (tokens by document, -1 for null), tokens (ids plus SHIFT, packed)."""
    if max(bpe.read_ranks(vocabulary).values(), default=0) + SHIFT >= TOP:
        raise ValueError(f"the vocabulary has ids of {TOP - SHIFT} and more")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        read = lister(bpe.read_ranks(vocabulary))
        keys, sizes, tokens, total = [], [], [], 0

        def flush():
            nonlocal made, keys, sizes, tokens, total
            all_keys = pa.concat_arrays(keys)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made], pa.int64()),
                    pa.ListArray.from_arrays([0, len(all_keys)], all_keys),
                    pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
                    pa.array([packed(np.concatenate(tokens).astype(np.uint32) + np.uint32(SHIFT), 3)], pa.binary()),
                ],
                ["chunk", "keys", "sizes", "tokens"],
            )
            made += 1
            keys, sizes, tokens, total = [], [], [], 0
            return row

        for b in batches:
            for i in range(0, b.num_rows, 200):
                s = b.slice(i, 200)
                words, ids, starts = read(s.column(1).to_pylist())
                keys.append(s.column(0))
                sizes.append(np.where(words < 0, -1, np.diff(starts)))
                tokens.append(ids)
                total += len(ids)
                if total >= chunk_tokens:
                    yield flush()
        if keys:
            yield flush()

    return df.select(field(df, key).alias("key"), field(df, text).alias("text")).mapInArrow(tidied(run), f"chunk bigint, keys array<{kind}>, sizes array<int>, tokens binary")


def histogram(chunks: DataFrame, n: int) -> np.ndarray:
    """How often each token, or a begin, stands before another: as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for b in batches:
            for sizes, blob in zip(b.column(0), b.column(1)):
                sums += np.bincount(unpacked(blob.as_py(), np.uint32), minlength=n)
                sums[BEGIN] += (np.asarray(sizes.values) > 0).sum()
        on = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(sums[on])], ["token", "n"])

    out = np.zeros(n, np.int64)
    for r in chunks.select("sizes", "tokens").mapInArrow(tidied(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r.token] = r.n
    return out


def by_shard(chunks: DataFrame, shards: Shards) -> DataFrame:
    """A row for each shard: shard, chunks, blobs (each chunk's distinct trigrams and
    counts), pairs (distinct last two tokens, and how many tokens stand before them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, sizes, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                keys, n = np.unique(trigrams(unpacked(blob.as_py(), np.uint32).astype(np.uint64), np.asarray(sizes.values))[0], return_counts=True)
                order, edge = shards.deal(keys)
                rows = [(s, squeeze(keys[at], n[at])) for s in np.flatnonzero(np.diff(edge)).tolist() for at in (order[edge[s] : edge[s + 1]],)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["shard", "chunk", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunk, blobs = None, [], []

        def flush():
            keys = np.unique(np.concatenate([unsqueeze(x)[0] for x in blobs]))
            pairs, n = np.unique((keys >> (B + B) << B) | (keys & LOW), return_counts=True)
            cols = [pa.array([current], pa.int32()), pa.array([chunk], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary())), pa.array([squeeze(pairs, n)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "chunks", "blobs", "pairs"])

        for b in batches:
            for s, c, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if s != current:
                    if blobs:
                        yield flush()
                    current, chunk, blobs = s, [], []
                chunk.append(c)
                blobs.append(blob.as_py())
        if blobs:
            yield flush()

    counted = chunks.select("chunk", "sizes", "tokens").mapInArrow(tidied(count), "shard int, chunk bigint, blob binary")
    return counted.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(tidied(gather), "shard int, chunks array<bigint>, blobs array<binary>, pairs binary")


def build_upper(gathered: DataFrame, shards: Shards, folder: str, n: int) -> np.ndarray:
    """Writes the upper level by group; unigram probabilities, in which unseen tokens share the discount of the seen."""

    def upper(t: pa.Table) -> pa.Table:
        keys, counts = zip(*(unsqueeze(x.as_py()) for x in t["pairs"]))
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        Level.build(keys >> B, keys & LOW, counts).save(f"{folder}/2/{t['group'][0].as_py()}")
        last, m = np.unique(keys & LOW, return_counts=True)
        return pa.table({"token": pa.array(last.astype(np.int64)), "n": pa.array(m.astype(np.int64))})

    groups = gathered.sparkSession.createDataFrame([(s, int(g)) for s, g in enumerate(shards.group_of)], "shard int, group int")
    pairs = gathered.select("shard", "pairs").join(groups, "shard").select("group", "pairs")
    seen = np.zeros(n)
    for r in pairs.groupBy("group").applyInArrow(upper, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        seen[r.token] = r.n
    if not seen.any():
        return np.full(n, 1 / n)
    return (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * (seen > 0).sum() / n) / seen.sum()


def answers(gathered: DataFrame, model: Model) -> DataFrame:
    """Writes the lower level by shard, and looks each chunk's trigrams up: chunk, shard, logs (steps of 1/QUANT, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, chunks = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                own = [unsqueeze(x.as_py()) for x in b.column(2)[i].values]
                keys, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in own])).astype(np.int64)
                upper = model.upper(int(model.shards.group_of[shard]))
                one, of = _runs(keys >> (B + B))
                rank, first, end, _ = (x[of] for x in upper.find((keys >> (B + B))[one]))
                place = upper.successor(rank, first, end, (keys & LOW).astype(np.int64))[0] - first
                Level.build((rank.astype(np.uint64) << B) | ((keys >> B) & LOW), place, counts, upper.contexts.n).save(f"{model.path}/3/{shard}")
                logs = quantised(look_up(upper, model.lower(shard), model.unigrams, keys))[back]
                ends = np.cumsum([len(k) for k, _ in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunks, pa.int64()), pa.array([shard] * len(chunks), pa.int32()), pa.array([packed(logs[e - len(k) : e]) for (k, _), e in zip(own, ends.tolist())], pa.binary())],
                    ["chunk", "shard", "logs"],
                )

    return gathered.select("shard", "chunks", "blobs").mapInArrow(tidied(run), "chunk bigint, shard int, logs binary")


def perplexities(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, shard_tokens: int = SHARD_TOKENS, chunk_tokens: int = CHUNK_TOKENS, path: str | None = None) -> DataFrame:
    """key, n_tokens, log_prob (natural, the end included), perplexity of every row
    under a model of all of them, whose trie is left in path."""
    spark = df.sparkSession
    key, text = name_of(df, key), name_of(df, text)
    kind = df.schema[key].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(field(df, text)))).first()[0] or 0
    parts = min(max(size // TABLE_BYTES, 8), 50_000)
    chunks = materialize_by(pack(df, key, text, vocabulary, chunk_tokens), "chunks", "chunk", parts)
    n = max(bpe.read_ranks(vocabulary).values(), default=0) + 1 + SHIFT
    shards = Shards(histogram(chunks, n), shard_tokens)
    folder = local_path(path or shared_dir(spark) + "/trie")
    gathered = materialize(by_shard(chunks, shards), "shards")
    model = Model(folder, shards, build_upper(gathered, shards, folder, n))
    found = answers(gathered, model).repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "logs"))).alias("found"))
    whole = chunks.join(found.select(F.col("chunk").alias("of"), F.col("found.logs").alias("logs")), F.col("chunk") == F.col("of"), "left").select("keys", "sizes", "tokens", "logs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes = np.asarray(b.column(1)[i].values)
                keys, row = trigrams(unpacked(b.column(2)[i].as_py(), np.uint32).astype(np.uint64), sizes)
                u, back = np.unique(keys, return_inverse=True)
                logs = np.zeros(len(u))
                if len(u):
                    logs[shards.deal(u)[0]] = np.concatenate([unpacked(x.as_py(), np.uint16) for x in b.column(3)[i].values]) / -QUANT
                sums = np.round(np.bincount(row, logs[back], len(sizes)), 4)
                null, none = sizes < 0, sizes < 1
                ppl = np.round(np.exp(-sums / (np.maximum(sizes, 0) + 1)), 4)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i].values, pa.array(sizes, pa.int32(), mask=null), pa.array(sums, mask=none), pa.array(ppl, mask=none)], ["key", "n_tokens", "log_prob", "perplexity"]
                )

    return whole.mapInArrow(tidied(run), f"key {kind}, n_tokens int, log_prob double, perplexity double").withColumnRenamed("key", key)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(table(spark, sf_dir, "documents"))
