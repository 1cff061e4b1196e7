"""Repeated passages by suffix sorting.

A passage repeats when a window of WINDOW words occurs at two places or more.
Each window belongs to its anchor, the run of GRAM words in it with the least
hash (the first of equals), so equal windows have equal anchors. Only the words
around an anchor travel, by the anchor's hash, once; anchors that come once hold
no repeated window and are dropped where they arrive. The windows of an anchor
are suffixes of the shipped texts. In a task they are sorted deep-shallow:
multikey quicksort, ternary by one word at a time and in step for all anchors (and
the windows' 16 bits), to
a depth of SHALLOW words, then blind tries order the groups that still share a
prefix. Neighbours in that order with a common prefix of WINDOW words are the
repeats. The first place (by id, then position) of each window is the original,
the others are marked, and marked windows are joined to spans.

The places of an anchor with more than HOT are dealt to blocks, which are sorted
apart. In a block all but the first place of a window are marked; the first go by
a hash of 128 bits to partial minima over the blocks, and a join, whose other side
has one row for a hash, marks all but the least.

Words are runs of characters that are not white space; they are compared by 32
bits of their hashes, and windows by 16 bits more that depend on the rest of all
their words' hashes, so windows that differ in one word only are taken for equal
once in 2**48 pairs. Positions count words.

Defined results: null texts and texts under WINDOW words have no spans; rows of
one id and one text are one document (a repeated row is no repeat), and of an id
with several texts each is read; rows without id are ignored; an empty table
gives none. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import field, map_batches, materialize, name_of, small, table

WINDOW = 50
GRAM = 8
SHALLOW = 4
#: Places of an anchor that a task sorts at once, at most.
HOT = 50_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, gram: int, mult: np.uint64 = MULT) -> np.ndarray:
    """Hash of each run of `gram` words, from the words' hashes."""
    x = np.zeros(len(h) - gram + 1, np.uint64)
    for j in range(gram):
        x = (x * mult) ^ h[j : len(h) - gram + 1 + j]
    return _mixed(x)


def anchors(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` places, the place of its least hash, the first of equals."""
    best, at = g.copy(), np.arange(len(g))
    span = 1
    while span < width:
        step = min(span, width - span)
        n = len(best) - step
        later = best[step:] < best[:n]
        best, at = np.where(later, best[step:], best[:n]), np.where(later, at[step:], at[:n])
        span += step
    return at


def _per_document(hashes: pa.Array, window: int, gram: int):
    """Row, hashes of words, then anchor, first and last window of each of its anchors."""
    flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offs = hashes.offsets.to_numpy()
    offs = offs - offs[0]
    for i in range(len(hashes)):
        h = flat[offs[i] : offs[i + 1]]
        if len(h) >= window:
            g = grams(h, gram)
            at = anchors(g, window - gram + 1)
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            yield i, h, g[at[edge]], at[edge], edge, np.concatenate([edge[1:], [len(at)]]) - 1


def blind_trie(items: list[bytes], lcp_known: int) -> list[list[int]]:
    """Numbers of equal strings (of one length, of 4-byte words, whose first
    lcp_known bytes agree), in order. Inner nodes hold only the word at which
    their strings part; a search goes down blindly, then compares with one leaf."""
    root: list = [-1, [0], items[0]]  # leaf: -1, numbers, string; inner: depth, children by word, some string
    for k in range(1, len(items)):
        s, node = items[k], root
        while node[0] >= 0:
            child = node[1].get(s[node[0] : node[0] + 4])
            if child is None:
                break
            node = child
        other = node[2]
        if s == other:
            node[1].append(k)
            continue
        d = lcp_known
        while s[d : d + 4] == other[d : d + 4]:
            d += 4
        node, parent, word = root, None, None
        while 0 <= node[0] < d:
            parent, word = node, s[node[0] : node[0] + 4]
            node = node[1].get(word)
            if node is None:
                break
        leaf = [-1, [k], s]
        if node is None:
            parent[1][word] = leaf
        elif node[0] == d:
            node[1][s[d : d + 4]] = leaf
        else:
            inner = [d, {other[d : d + 4]: node, s[d : d + 4]: leaf}, other]
            if parent is None:
                root = inner
            else:
                parent[1][word] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out.append(node[1])
        else:
            stack += [c for _, c in sorted(node[1].items(), reverse=True)]
    return out


def multikey(words: np.ndarray, starts: np.ndarray, group: np.ndarray, shallow: int) -> list[np.ndarray]:
    """Groups of starts whose suffixes share `shallow` words, in order. group: what
    the starts are ordered by beforehand. Ternary quicksort on one word at a time:
    in each round all groups are parted by a word of their own into less, equal and
    greater; the equal go on with the next word, lone suffixes leave."""
    at = starts[np.argsort(group, kind="stable")]
    edge = np.flatnonzero(np.diff(np.sort(group), prepend=-1))
    size = np.diff(np.append(edge, len(at)))
    place, depth = edge.astype(np.int64), np.zeros(len(edge), np.int64)
    out: list[tuple[int, np.ndarray]] = []
    while len(size):
        done = (depth >= shallow) & (size > 1)
        begins = np.cumsum(size) - size
        out += [(int(place[k]), at[begins[k] : begins[k] + size[k]]) for k in np.flatnonzero(done)]
        keep = (depth < shallow) & (size > 1)
        at = at[np.repeat(keep, size)]
        size, place, depth = size[keep], place[keep], depth[keep]
        if not len(size):
            break
        begins = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        w = words[at + depth[own]]
        # the middle one of the first, the middle and the last word
        three = np.sort(np.stack([w[begins], w[begins + size // 2], w[begins + size - 1]]), axis=0)[1]
        part = own * 3 + (w >= three[own]) + (w > three[own])
        order = np.argsort(part, kind="stable")
        at, part = at[order], part[order]
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        old, which = part[edge] // 3, part[edge] % 3
        place, depth = place[old] + edge - begins[old], depth[old] + (which == 1)
        size = np.diff(np.append(edge, len(at)))
    return [g for _, g in sorted(out, key=lambda x: x[0])]


def repeats(words: np.ndarray, starts: np.ndarray, window: int, shallow: int = SHALLOW, group: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Groups of two or more starts, of one group, with equal windows."""
    shallow = min(shallow, window)
    raw = words.astype(">u4").tobytes()
    for many in multikey(words, starts, np.zeros(len(starts), np.int64) if group is None else group, shallow):
        items = [raw[4 * a : 4 * (a + window)] for a in many.tolist()]
        for same in blind_trie(items, 4 * shallow):
            if len(same) > 1:
                yield many[same]


def _unpacked(raw: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of shipped runs, 4 bytes of each word and then 2 of each window: words, their
    number by run, and what the windows have more."""
    length = (np.fromiter(map(len, raw), np.int64, len(raw)) - 2 * windows) // 4
    cut = (4 * length).tolist()
    words = np.frombuffer(b"".join([x[:n] for x, n in zip(raw, cut)]), np.uint32)
    return words, length, np.frombuffer(b"".join([x[n:] for x, n in zip(raw, cut)]), np.uint16)


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shallow: int = SHALLOW, hot: int = HOT) -> DataFrame:
    """key, start, end: spans of words that repeat an earlier passage."""
    key, text = name_of(df, key), name_of(df, text)
    kind = df.schema[key].dataType.simpleString()
    body = field(df, text)
    hashes = F.transform(F.filter(F.split(body, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    docs = df.where(field(df, key).isNotNull() & body.isNotNull()).select(field(df, key).alias("key"), F.xxhash64(body).alias("version"), hashes.alias("h"))

    def count():
        def fn(b: pa.RecordBatch):
            found = [a for _, _, a, _, _, _ in _per_document(b.column(0), window, gram)]
            u, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["anchor", "n"])

        return fn

    counted = map_batches(docs.select("h"), count, "anchor bigint, n bigint", rows=500).groupBy("anchor").agg(F.sum("n").alias("n"))
    crowded = counted.where(F.col("n") > hot).select(F.col("anchor").alias("crowded"), F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    crowded = materialize(crowded, "hot_anchors")

    def ship():
        def fn(b: pa.RecordBatch):
            rows, anchor, start, data, windows = [], [], [], [], []
            for i, h, a, _, lo, hi in _per_document(b.column(2), window, gram):
                low, more = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), grams(_mixed(h >> np.uint64(32)), window).astype(np.uint16).tobytes()
                rows += [i] * len(a)
                anchor.append(a.view(np.int64))
                start.append(lo)
                windows.append(hi - lo + 1)
                data += [low[4 * x : 4 * (y + window)] + more[2 * x : 2 * (y + 1)] for x, y in zip(lo.tolist(), hi.tolist())]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cat(anchor)), b.column(0).take(at), b.column(1).take(at), pa.array(cat(start).astype(np.int32)), pa.array(cat(windows).astype(np.int32)), pa.array(data, pa.binary())],
                ["anchor", "key", "version", "start", "windows", "words"],
            )

        return fn

    around = map_batches(docs, ship, f"anchor bigint, key {kind}, version bigint, start int, windows int, words binary", rows=500)
    if crowded.isEmpty():
        dealt = around.select("*", F.lit(0).alias("block"), F.lit(False).alias("hot"))
    else:
        dealt = around.join(small(crowded), around["anchor"] == crowded["crowded"], "left")
        block = F.coalesce(F.pmod(F.xxhash64("key", "version", "start"), F.col("blocks")).cast("int"), F.lit(0))
        dealt = dealt.select(*around.columns, block.alias("block"), F.col("crowded").isNotNull().alias("hot"))

    names = ["key", "version", "start", "end", "one", "two"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush(final: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            anchor, block = t["anchor"].to_numpy(), t["block"].to_numpy()
            of = np.cumsum(np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]))
            cut = len(of) if final else int(np.searchsorted(of, of[-1]))
            rest = t.slice(cut)
            t = t.slice(0, cut)
            held, size = (rest.to_batches(), rest["words"].nbytes) if rest.num_rows else ([], 0)
            if not cut:
                return
            n = t["windows"].to_numpy().astype(np.int64)
            words, length, more = _unpacked(t["words"].to_pylist(), n)
            base = np.cumsum(length) - length
            owner = np.repeat(np.arange(cut), n)
            shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            starts = base[owner] + shift  # distinct and in order
            group = of[owner] << 16 | more
            keys, version, place = t["key"].to_pylist(), t["version"].to_pylist(), t["start"].to_numpy()
            marked: list[int] = []
            for same in repeats(words, starts, window, shallow, group):
                w = np.searchsorted(starts, same)
                rank = sorted((keys[owner[x]], int(place[owner[x]]) + int(shift[x]), version[owner[x]], x) for x in w.tolist())
                # a repeated row is the same place again: it stays as its original stays, and goes as it goes
                marked += [r[3] for r in rank if r[:3] != rank[0][:3]]
            m = np.sort(np.array(marked, np.int64))
            o, p = owner[m], place[owner[m]] + shift[m]
            if len(m):
                edge = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]))
                last = np.concatenate([edge[1:], [len(m)]]) - 1
                take = pa.array(o[edge])
                ks, vs = (pa.concat_arrays(t[c].take(take).chunks) for c in ("key", "version"))
                none = pa.nulls(len(edge), pa.int64())
                yield pa.RecordBatch.from_arrays([ks, vs, pa.array(p[edge].astype(np.int32)), pa.array((p[last] + window).astype(np.int32)), none, none], names)
            hot = t["hot"].to_numpy()
            if hot.any():
                # the block's first places, by what their windows hold
                held_back = hot[owner]
                held_back[m] = False
                sub = np.repeat(hot, length)
                w, below = words[sub].astype(np.uint64), np.cumsum(~sub)
                x = np.flatnonzero(held_back)
                at = starts[x] - below[starts[x]]
                two = [grams(_mixed(y), window, k)[at] for y, k in ((w, MULT), (w ^ MULT, np.uint64(0xC2B2AE3D27D4EB4F)))]
                two = [y.view(np.int64) for y in (two[0], _mixed(two[1] ^ more[x]))]
                ks, vs = (pa.concat_arrays(t[c].take(pa.array(owner[x])).chunks) for c in ("key", "version"))
                yield pa.RecordBatch.from_arrays([ks, vs, pa.array((place[owner[x]] + shift[x]).astype(np.int32)), pa.nulls(len(x), pa.int32()), *map(pa.array, two)], names)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column(5).nbytes
                if size >= 20 << 20:
                    yield from flush(False)
        if held:
            yield from flush(True)

    # one shuffle; what comes once goes before it reaches Python
    again = dealt.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("anchor", "block"))).where("n > 1 or hot").drop("n")
    found = again.sortWithinPartitions("anchor", "block").mapInArrow(sort, f"key {kind}, version bigint, start int, end int, one bigint, two bigint")
    if not crowded.isEmpty():
        found = materialize(found, "found")
        place = F.struct("key", "start", "version")
        held = found.where("end is null")
        first = held.groupBy(F.col("one").alias("a"), F.col("two").alias("b")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
        later = held.join(first, (F.col("one") == F.col("a")) & (F.col("two") == F.col("b"))).where(place != F.col("first"))
        found = found.where("end is not null").select("key", "version", "start", "end").unionByName(later.select("key", "version", "start", (F.col("start") + window).cast("int").alias("end")))
    # spans of one document that touch or overlap are one
    parts = found.groupBy("key", "version").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    joined = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return parts.select("key", F.explode(joined).alias("x")).select(F.col("key").alias(key), "x.start", "x.end").distinct()


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
