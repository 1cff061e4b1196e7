"""BPE encoding through a table of distinct words, and decoding through a table
of pieces.

Texts are split into words in Spark tasks. A task packs its documents into
chunks: the chunk's distinct words, in order of arrival, and for each position the
number of its word. Only words travel to be encoded, compressed by bucket of their
hash: a bucket's words of all chunks meet, each distinct word is encoded once, and
its ids go back to their chunk by a join, where positions take them. Texts and
positions are never shuffled: the chunks' table is bucketed by chunk. Nothing that
is broadcast grows with the corpus. Decoding sends the distinct ids of a block of
rows through a join with the table of pieces, whose size is the vocabulary's,
behind the block itself; the block's positions take the pieces, and no row leaves
its task.

Defined results: a null text has null ids (and decodes to null), an empty text
none; repeated rows and null keys are carried along; an empty table gives an
empty result. Other columns, whatever their names, are ignored by encode and kept
by decode. An id outside the vocabulary, or a null one, is an error of the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import bpe
from pathloom.llm.common import BATCH_ROWS, field, map_arrow, materialize_by, name_of, table, tidied

#: Positions in a chunk, about.
CHUNK_WORDS = 1_000_000
#: Buckets of words: one for so many bytes of text, within bounds (each chunk has a blob for each bucket).
BUCKET_BYTES = 32 << 20
BUCKETS = (64, 4096)
#: Chunks lie in a bucketed table, a bucket for so many bytes of text, so that they need no shuffle to meet their ids.
TABLE_BYTES = 16 << 20
TABLE_BUCKETS = (8, 50_000)
#: Words of a bucket that a task remembers; beyond, some may be encoded again.
REMEMBERED = 2_000_000
#: Ids of a block that is decoded at once, about.
BLOCK_IDS = 200_000


def buckets_for(size: int, each: int = BUCKET_BYTES, bounds: tuple[int, int] = BUCKETS) -> int:
    return min(max(size // each, bounds[0]), bounds[1])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight lie together, which packs better."""
    x = np.ascontiguousarray(x.astype(np.uint32))
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1)


def pack_lists(lists: list, joined: bytes) -> bytes:
    """Sizes of the lists, then what they hold."""
    import zstandard

    sizes = _planes(np.fromiter(map(len, lists), np.int64, len(lists)))
    return zstandard.ZstdCompressor(level=3).compress(len(lists).to_bytes(4, "little") + sizes + joined)


def unpack_lists(blob: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return _from_planes(raw[4 : 4 + 4 * n]).astype(np.int64), raw[4 + 4 * n :]


class _Numbers(dict):
    """Number of a word, in order of arrival."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(df: DataFrame, key: str, text: str, chunk_words: int = CHUNK_WORDS, buckets: int = BUCKETS[0]) -> DataFrame:
    """A row for each chunk: chunk, keys, sizes (words by document, -1 for null),
    codes (number of the word at each position), words (bucket of each); and one for
    each of its buckets: chunk, bucket, words."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"chunk bigint, bucket int, keys array<{kind}>, sizes array<int>, codes binary, words binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        split = bpe.splitter()
        keys, sizes, codes, total, at = [], [], [], 0, _Numbers()

        def flush():
            nonlocal made, keys, sizes, codes, total, at
            all_keys = pa.concat_arrays(keys)
            raw = [w.encode() for w in at]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.uint32, len(raw))
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            blobs, names = [], []
            for b in np.flatnonzero(np.diff(edge)).tolist():
                words = [raw[i] for i in order[edge[b] : edge[b + 1]].tolist()]
                blobs.append(pack_lists(words, b"".join(words)))
                names.append(b)
            n = len(blobs)
            press = zstandard.ZstdCompressor(level=3).compress
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made] * (n + 1), pa.int64()),
                    pa.array([None, *names], pa.int32()),
                    pa.concat_arrays([pa.ListArray.from_arrays([0, len(all_keys)], all_keys), pa.nulls(n, pa.list_(all_keys.type))]),
                    pa.array([sizes, *[None] * n], pa.list_(pa.int32())),
                    pa.array([press(_planes(np.concatenate(codes) if codes else np.zeros(0, np.uint32))), *[None] * n], pa.binary()),
                    pa.array([press(_planes(bucket)), *blobs], pa.binary()),
                ],
                ["chunk", "bucket", "keys", "sizes", "codes", "words"],
            )
            made += 1
            keys, sizes, codes, total, at = [], [], [], 0, _Numbers()
            return row

        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                s = b.slice(i, BATCH_ROWS)
                keys.append(s.column(0))
                for t in s.column(1).to_pylist():
                    if t is None:
                        sizes.append(-1)
                        continue
                    words = split(t)
                    sizes.append(len(words))
                    if words:
                        codes.append(np.fromiter(map(at.__getitem__, words), dtype=np.uint32, count=len(words)))
                        total += len(words)
                if total >= chunk_words:
                    yield flush()
        if sizes:
            yield flush()

    return df.select(field(df, key).alias("key"), field(df, text).alias("text")).mapInArrow(tidied(run), schema)


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """chunk, bucket, ids of the words of each chunk and bucket; a word that
    several chunks have is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, current = None, {}, None
        for t in batches:
            out = []
            encode = encode or bpe.encoder(bpe.read_ranks(vocabulary))
            for bucket, blob in zip(t.column(1).to_pylist(), t.column(2)):
                if bucket != current or len(known) > REMEMBERED:  # rows come by bucket
                    known, current = {}, bucket
                sizes, joined = unpack_lists(blob.as_py())
                ends = np.cumsum(sizes).tolist()
                lists = []
                for a, b in zip([0, *ends], ends):
                    w = joined[a:b]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode(w)
                    lists.append(ids)
                out.append(pack_lists(lists, _planes(np.fromiter((i for x in lists for i in x), np.int64))))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(out, pa.binary())], ["chunk", "bucket", "ids"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "chunk bigint, bucket int, ids binary")


def _encoded(df: DataFrame, key: str, text: str, vocabulary: str, chunk_words: int) -> tuple[DataFrame, Callable, T.StructType]:
    """Chunks with the ids of their words, what makes rows of them, and the rows' schema."""
    key, text = name_of(df, key), name_of(df, text)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])
    size = df.agg(F.sum(F.octet_length(field(df, text)))).first()[0] or 0
    parts = buckets_for(size, TABLE_BYTES, TABLE_BUCKETS)
    chunks = materialize_by(pack(df, key, text, chunk_words, buckets_for(size)), "chunks", "chunk", parts)
    ids = encode_words(chunks.where("bucket is not null").select("chunk", "bucket", "words"), vocabulary)
    ids = ids.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("found")).select(F.col("chunk").alias("of"), F.col("found.ids").alias("ids"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in range(batch.num_rows):
                count, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for blob in batch.column(4)[row].as_py() or ():
                    n, raw = unpack_lists(blob)
                    count.append(n)
                    pool.append(_from_planes(raw).astype(np.int32))
                count, pool = np.concatenate(count), np.concatenate(pool)
                base = np.cumsum(count) - count
                # they come by bucket, the words are numbered by arrival
                order = np.argsort(_from_planes(zstandard.ZstdDecompressor().decompress(batch.column(3)[row].as_py())), kind="stable")
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                count, base = count[back], base[back]
                keys = batch.column(0).slice(row, 1).flatten()
                sizes = batch.column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
                codes = _from_planes(zstandard.ZstdDecompressor().decompress(batch.column(2)[row].as_py()))
                words_to = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
                for i in range(0, len(sizes), BATCH_ROWS):
                    j = min(len(sizes), i + BATCH_ROWS)
                    c = codes[words_to[i] : words_to[j]]
                    n = count[c]
                    upto = np.concatenate([[0], np.cumsum(n)])
                    tokens = pool[np.repeat(base[c] - upto[:-1], n) + np.arange(upto[-1])] if len(c) else np.zeros(0, np.int32)
                    starts = upto[words_to[i : j + 1] - words_to[i]].astype(np.int32)
                    null = pa.array(sizes[i:j] < 0)
                    lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(tokens, pa.int32()), mask=null)
                    yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), lists, pa.array(np.diff(starts), mask=sizes[i:j] < 0)], ["key", "token_ids", "n_tokens"])

    body = chunks.where("bucket is null").select("chunk", "keys", "sizes", "codes", "words")
    whole = body.join(ids, body["chunk"] == ids["of"], "left").select("keys", "sizes", "codes", "words", "ids")
    return whole, unpack, schema


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """key, token_ids, n_tokens of every row."""
    whole, unpack, schema = _encoded(df, key, text, vocabulary, chunk_words)
    return whole.mapInArrow(tidied(unpack), schema).withColumnRenamed("key", name_of(df, key))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """key, token_ids, n_tokens, text (decoded again) of every row: decode(encode(df)) with a Python process less."""
    whole, unpack, schema = _encoded(df, key, text, vocabulary, chunk_words)
    sent = whole.mapInArrow(tidied(lambda batches: _ask(unpack(batches), 1)), "block binary, asked int")
    return _answered(sent, schema, 1, "text", vocabulary).withColumnRenamed("key", name_of(df, key))


def pieces(spark: SparkSession, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """id, piece: as many rows as the vocabulary has."""
    table_ = pa.table([pa.array(list(x)) for x in zip(*((i, p) for p, i in bpe.read_ranks(vocabulary).items()))], ["id", "piece"])
    return spark.createDataFrame(table_).select(F.col("id").cast("int"), "piece")


def _ask(batches: Iterator[pa.RecordBatch], where: int) -> Iterator[pa.RecordBatch]:
    """A block of rows as one row, then one for each of its distinct ids, in order. where: the column of ids."""
    for big in batches:
        at = 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(big.column(where)), 0).to_numpy())
        while at < big.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_IDS, side="right")))
            b = big.slice(at, to - at)
            at = to
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b)
            asked = pc.unique(b.column(where).flatten()).sort().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes(), *[None] * len(asked)], pa.binary()), pa.concat_arrays([pa.nulls(1, pa.int32()), asked])], ["block", "asked"])


def _answered(sent: DataFrame, schema: T.StructType, where: int, text: str, vocabulary: str) -> DataFrame:
    """The rows of the blocks with their texts."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, got = None, [], []

        def flush():
            b = pa.ipc.open_stream(block).read_next_batch()
            one, piece = (pa.concat_arrays(x) if x else pa.array([], k) for x, k in ((asked, pa.int32()), (got, pa.binary())))
            if one.null_count or piece.null_count:
                raise ValueError(f"an id is null or outside the vocabulary: {one.filter(piece.is_null())[0]}")
            lists = b.column(where)
            flat = piece.take(pa.array(np.searchsorted(one.to_numpy(), lists.flatten().to_numpy())))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            offs = (np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :] if len(flat) else np.zeros(1, np.int32))[ends]
            raw = flat.buffers()[2] if len(flat) and flat.buffers()[2] is not None else pa.py_buffer(b"")
            texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offs.astype(np.int32)), raw])
            if lists.null_count:
                texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), texts)
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:  # ids that no text gives
                texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "text"])

        for b in batches:
            new = np.flatnonzero(np.asarray(b.column(0).is_valid())).tolist()
            starts = set(new)
            first = [0] if b.num_rows and 0 not in starts else []
            for i, j in zip([*first, *new], [*(first and new or new[1:]), b.num_rows]):
                if i in starts:
                    if block is not None:
                        yield flush()
                    block, asked, got = b.column(0)[i].as_py(), [], []
                    i += 1
                if i < j:
                    asked.append(b.column(1).slice(i, j - i))
                    got.append(b.column(2).slice(i, j - i))
        if block is not None:
            yield flush()

    # the side that streams keeps its order
    known = pieces(sent.sparkSession, vocabulary)
    met = sent.join(F.broadcast(known), sent["asked"] == known["id"], "left").select("block", "asked", "piece")
    return map_arrow(met, answer, T.StructType([*schema.fields, T.StructField(text, T.StringType())]))


def decode(df: DataFrame, ids: str = "token_ids", text: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """df with the text of its ids."""
    ids = name_of(df, ids)
    if text.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input has a column {text} already")
    where = df.columns.index(ids)
    return _answered(map_arrow(df, lambda batches: _ask(batches, where), "block binary, asked int"), df.schema, where, text, vocabulary)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)
