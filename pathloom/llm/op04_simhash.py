"""Near-duplicates by SimHash, compared bit-sliced.

A document's 128-bit signature sums, bit by bit, the hashes of its distinct
words. Equal signatures are one. The others meet in tables keyed by some chosen
bits of the signature, more bits for more documents; enough tables are used that
a pair at the very RADIUS meets with probability RECALL, and nearer pairs more
often. In a task all rows, ordered by table and key, are packed 64 to a word with
one bit plane for each bit of the signature; a row is compared with all later
rows of its key at once: differing bits are added into carry-save counters, a
block is abandoned as soon as all of its 64 distances exceed the radius. The rows
of a key with more than HOT are dealt to blocks, and each pair of blocks is a
task's work of its own, so no task holds a whole hot key. A task joins what is
linked within a key itself, and hands on one row for each linked signature, never
the pairs. Groups are then closed by star contraction. The lowest id of a group
stays.

A document is an id with a text. Words are runs of letters and digits,
lower-cased, each counted once.

Defined results: null and empty texts, and texts without a word, have no
signature, are never grouped and are all kept; repeated rows (one id, one text)
are one document, and of them keep_one leaves the row whose JSON is least; rows
of one id with different texts are documents of their own, each grouped by its
text, and where several of them are lowest in a group the one with the least hash
stays; rows without id are not grouped and are kept; an empty table gives an
empty result. Extra columns, whatever their names, are ignored by groups and kept
by keep_one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import field, map_arrow, map_batches, materialize, name_of, small, table, with_fresh

RADIUS = 18
RECALL = 0.9
#: Bits of a table's key: these at least, and so many that this many rows share a key.
LEAST_BITS, SHARE = 16, 1024
#: Rows of one key that a task compares at once, about.
HOT = 50_000
#: Planes between two looks at whether a block can be abandoned.
LOOK = 16
SPLIT = r"[^\p{L}\p{N}]+"


def version_of(df: DataFrame, text: str) -> Column:
    return F.xxhash64(field(df, text))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, version (the text's hash), hi, lo of every row that has an id and a word."""
    key, text = name_of(df, key), name_of(df, text)
    kind = df.schema[key].dataType.simpleString()
    words = F.array_distinct(F.split(F.lower(field(df, text)), SPLIT))
    hashes = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))

    def make():
        def fn(b: pa.RecordBatch):
            col = b.column(2)
            flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = np.diff(col.offsets.to_numpy())
            on = np.flatnonzero(size)
            other = flat * np.uint64(0xC2B2AE3D27D4EB4F)
            other ^= other >> np.uint64(29)
            other *= np.uint64(0x165667B19E3779F9)
            other ^= other >> np.uint64(32)
            ends = np.cumsum(size)
            sig = np.zeros((2, len(on)), np.uint64)
            for k, i in enumerate(on):
                s = slice(ends[i] - size[i], ends[i])
                for j, h in enumerate((flat, other)):
                    bits = np.unpackbits(h[s].view(np.uint8)).reshape(-1, 64)
                    sig[j, k] = np.packbits(bits.sum(0, dtype=np.int32) * 2 > size[i]).view(np.uint64)[0]
            at = pa.array(on)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64))], ["id", "version", "hi", "lo"])

        return fn

    some = df.where(field(df, key).isNotNull() & field(df, text).isNotNull()).select(field(df, key).alias("id"), version_of(df, text).alias("version"), hashes.alias("h"))
    return map_batches(some, make, f"id {kind}, version bigint, hi bigint, lo bigint", rows=500)


def bits_for(rows: int) -> int:
    """Bits of the keys of a table of so many different signatures."""
    return max(LEAST_BITS, (max(1, rows) // SHARE).bit_length())


def tables_needed(radius: int = RADIUS, bits: int = LEAST_BITS, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / 128) ** bits))


def chosen_bits(n_tables: int, bits: int = LEAST_BITS) -> np.ndarray:
    """The bits of each table's key: random, the same in every run."""
    rng = np.random.default_rng(20)
    return np.stack([rng.choice(128, bits, replace=False) for _ in range(n_tables)])


def keyed(sigs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """place (table and key), hi, lo, id, version for each table."""
    n, bits = chosen.shape

    def make():
        def fn(b: pa.RecordBatch):
            half = [b.column(i).to_numpy().view(np.uint64) for i in (2, 3)]
            place = np.zeros((n, b.num_rows), np.int64)
            for t, bs in enumerate(chosen):
                for x in bs:
                    place[t] = place[t] << 1 | ((half[x >> 6] >> np.uint64(x & 63)) & np.uint64(1)).astype(np.int64)
                place[t] |= t << bits
            again = pa.array(np.tile(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.reshape(-1)), *(pa.array(np.tile(h.view(np.int64), n)) for h in half), b.column(0).take(again), b.column(1).take(again)], ["place", "hi", "lo", "id", "version"]
            )

        return fn

    kind = sigs.schema["id"].dataType.simpleString()
    return map_batches(sigs.select("id", "version", "hi", "lo"), make, f"place bigint, hi bigint, lo bigint, id {kind}, version bigint", rows=2000)


def in_blocks(rows: DataFrame, hot: int) -> DataFrame:
    """rows with own (their block of their key), one and two (the pair of blocks that
    is compared): a key with at most `hot` rows is one block with itself."""
    many = materialize(rows.groupBy("place").count().where(F.col("count") > hot).select(F.col("place").alias("crowded"), F.ceil(F.col("count") / hot).cast("int").alias("blocks")), "hot_keys")
    if many.isEmpty():
        return rows.select("*", F.lit(0).alias("own"), F.lit(0).alias("one"), F.lit(0).alias("two"))
    dealt = rows.join(small(many), rows["place"] == many["crowded"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("place", "hi", "lo", "id", "version", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(planes: np.ndarray, row: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, word) pairs those whose word has lanes at most radius away from the
    row, with the mask of these lanes. Planes are 128 by words."""
    lane = (row & 63).astype(np.uint64)
    home = row >> 6
    width = (radius + 1).bit_length()
    live = np.arange(len(row))
    counter = [np.zeros(len(row), np.uint64) for _ in range(width)]
    over = np.zeros(len(row), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    exceed = over
    for start in range(0, 128, LOOK):
        for k in range(start, start + LOOK, 4):
            d = []
            for p in range(k, k + 4):
                bit = (planes[p][home[live]] >> lane[live]) & np.uint64(1)
                d.append(planes[p][word[live]] ^ (np.uint64(0) - bit))
            # four bits a lane make a sum of ones, twos and fours
            one, two = _csa(d[0], d[1], d[2])
            one, carry = one ^ d[3], one & d[3]
            two, four = two ^ carry, two & carry
            for x, at in ((one, 0), (two, 1), (four, 2)):
                for i in range(at, width):
                    counter[i], x = counter[i] ^ x, counter[i] & x
                over = over | x
        # lanes whose counter is more than the radius
        exceed, equal = over.copy(), ~over
        for i in range(width - 1, -1, -1):
            if radius >> i & 1:
                equal &= counter[i]
            else:
                exceed |= equal & counter[i]
                equal &= ~counter[i]
        keep = exceed != full
        if not keep.all():
            live, over, exceed = live[keep], over[keep], exceed[keep]
            counter = [c[keep] for c in counter]
            if not len(live):
                break
    return live, ~exceed


def compare(place: np.ndarray, hi: np.ndarray, lo: np.ndarray, radius: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows ordered by place that share it and are within the radius."""
    n = len(place)
    if n < 2:
        return
    end = np.searchsorted(place, place, side="right")
    pad = -n % 64
    both = np.concatenate([np.stack([lo, hi]).view(np.uint64), np.zeros((2, pad), np.uint64)], axis=1)
    planes = np.empty((128, (n + pad) // 64), np.uint64)
    for x in range(128):
        bits = ((both[1 - (x >> 6)] >> np.uint64(x & 63)) & np.uint64(1)).astype(np.uint8)
        planes[x] = np.packbits(bits, bitorder="little").view(np.uint64)
    first, last = (np.arange(n) + 1) >> 6, (end - 1) >> 6
    count = np.where(end > np.arange(n) + 1, last - first + 1, 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + chunk, side="right")) - 1)
        c = count[at:to]
        row = np.repeat(np.arange(at, to), c)
        word = np.repeat(first[at:to] - upto[at:to], c) + np.arange(upto[at], upto[to])
        for s in range(0, len(row), chunk):
            r, w = row[s : s + chunk], word[s : s + chunk]
            live, mask = within(planes, r, w, radius)
            if len(live):
                r, w = r[live], w[live]
                bits = np.unpackbits(mask.view(np.uint8), bitorder="little").reshape(-1, 64)
                a, b = np.nonzero(bits)
                i, j = r[a], w[a] * 64 + b
                on = (j > i) & (j < end[i])
                yield i[on], j[on]
        at = to


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find over an array, many edges at a time: the new least roots."""
    while True:
        a, b = root[i], root[j]
        on = a != b
        if not on.any():
            return root
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def linked(sigs: DataFrame, radius: int = RADIUS, bits: int | None = None, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """a, b, links: b is linked with a (by way of others of its key, maybe), and
    has met so many within the radius that it didn't meet in an earlier table; at
    most one row for each signature and pair of blocks of a table. a and b are
    structs of id and version. sigs: id, version, hi, lo, no signature twice."""
    bits = bits or bits_for(sigs.count())
    chosen = chosen_bits(tables_needed(radius, bits, recall), bits)
    masks = np.zeros((len(chosen), 2), np.uint64)
    for t, bs in enumerate(chosen):
        for x in bs:
            masks[t, x >> 6] |= np.uint64(1) << np.uint64(x & 63)
    kind = sigs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by place and pair of blocks; those of one stay together
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(final: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            place, one, two, own = (t[f"c{i}"].to_numpy() for i in (0, 6, 7, 5))
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            group = np.cumsum(new)
            cut = len(group) if final else int(np.searchsorted(group, group[-1]))
            rest = t.slice(cut)
            held, size = (rest.to_batches(), rest.num_rows) if rest.num_rows else ([], 0)
            if not cut:
                return
            t, group, place, own, across = t.slice(0, cut), group[:cut], place[:cut], own[:cut], (one != two)[:cut]
            hi, lo = (t[f"c{i}"].to_numpy() for i in (1, 2))
            uhi, ulo = hi.view(np.uint64), lo.view(np.uint64)
            root, links = np.arange(cut), np.zeros(cut, np.int64)
            for i, j in compare(group, hi, lo, radius):
                # two of one block meet where that block is by itself
                on = ~across[i] | (own[i] != own[j])
                i, j = i[on], j[on]
                root = unite(root, i, j)
                high, low, at = uhi[i] ^ uhi[j], ulo[i] ^ ulo[j], place[i] >> bits
                first = np.arange(len(i))
                for s in range(int(at.max(initial=0))):
                    met = (at[first] > s) & (high[first] & masks[s, 0] == 0) & (low[first] & masks[s, 1] == 0)
                    first = first[~met]
                links += np.bincount(i[first], minlength=cut) + np.bincount(j[first], minlength=cut)
            head = np.zeros(cut, bool)
            head[root[root != np.arange(cut)]] = True
            on = np.flatnonzero((root != np.arange(cut)) | head & (links > 0))
            b, a = pa.array(on), pa.array(root[on])
            cols = [t[c].take(x) for x in (a, b) for c in ("c3", "c4")]
            cols = [c.combine_chunks() for c in cols]
            cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(links[on])], ["a", "av", "b", "bv", "links"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
                if size >= 500_000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    rows = in_blocks(keyed(sigs, chosen), hot).repartition("place", "one", "two").sortWithinPartitions("place", "one", "two")
    found = map_arrow(rows, run, f"a {kind}, av bigint, b {kind}, bv bigint, links bigint")
    return found.select(F.struct(F.col("a").alias("id"), F.col("av").alias("version")).alias("a"), F.struct(F.col("b").alias("id"), F.col("bv").alias("version")).alias("b"), "links")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least id that it is connected with) of every node of the
    edges a < b; alternating large and small stars, each round a written table."""
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    while True:
        # large star: neighbours above a node are tied to its least neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        # small star: a node and its lower neighbours are tied to the least of them
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        down = down.select(F.col("b").alias("n"), "m")
        small_ = large.join(down, large["b"] == down["n"]).select(F.col("m"), "a", "b")
        new = small_.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        new = materialize(new, "edges")
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _grouped(df: DataFrame, key: str, text: str, radius: int, bits: int | None, recall: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and own (id and version), group (the same of the one that stays), links of each document."""
    sigs = materialize(signatures(df, key, text), "signatures")
    one = materialize(sigs.groupBy("hi", "lo").agg(F.min(F.struct("id", "version")).alias("node")), "distinct_signatures")
    near = materialize(linked(one.select("node.*", "hi", "lo"), radius, bits, recall, hot), "links")
    root = components(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    links = near.groupBy(F.col("b").alias("of")).agg(F.sum("links").alias("links"))
    known = one.join(root, one["node"] == root["node"], "left").select("hi", "lo", one["node"].alias("of"), F.coalesce("root", one["node"]).alias("group"))
    known = known.join(links, "of", "left").select("hi", "lo", "group", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    own = sigs.groupBy("id", "version").agg(F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    return sigs, own.join(known, ["hi", "lo"]).select(F.struct("id", "version").alias("own"), "group", "links")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bits: int | None = None, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """key, group_id (the group's lowest key), links (to how many other signatures
    the document's is within the radius, as far as the tables find them), kept: one
    row for each document with a word."""
    key = name_of(df, key)
    found = _grouped(df, key, text, radius, bits, recall, hot)[1]
    return found.select(F.col("own.id").alias(key), F.col("group.id").alias("group_id"), "links", (F.col("own") == F.col("group")).alias("kept"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bits: int | None = None, recall: float = RECALL, hot: int = HOT) -> DataFrame:
    """df without the documents of a group that are not its lowest; of repeated
    rows one stays. Only ids and hashes of what goes meet the texts."""
    key, text = name_of(df, key), name_of(df, text)
    sigs, found = _grouped(df, key, text, radius, bits, recall, hot)
    gone, hashed = with_fresh(df, "gone"), with_fresh(df, "hashed")
    named = [F.col("id").alias(gone), F.col("version").alias(hashed)]

    def minus(rows: DataFrame, what: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.join(small(what), (field(rows, key) == what[gone]) & (version_of(rows, text) == what[hashed]), how)

    out = minus(df, materialize(found.where(F.col("own") != F.col("group")).select("own.*").select(*named), "dropped"))
    again = materialize(sigs.groupBy("id", "version").count().where("count > 1").select(*named), "repeated")
    if again.isEmpty():
        return out
    row = F.struct(*[field(out, c) for c in out.columns])
    twice = minus(out, again, "left_semi").groupBy(field(out, key).alias(gone), version_of(out, text).alias(hashed)).agg(F.min_by(row, F.to_json(row)).alias(gone + "_row"))
    return minus(out, again).unionByName(twice.select(gone + "_row.*"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
