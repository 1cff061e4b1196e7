"""Sharding by fixed virtual slots.

A record's slot is a hash of its key modulo a fixed number of slots; slots, not
records, are dealt to shards. Bytes are summed by slot, and rebalancing edits
the map: shards above the mean give up their last slots, and these fill the
gaps of the others in order. Each edit is a new version of the stored map, which
any later session finds by the store's path and edits further.

Defined results: a null key hashes as the empty string, null texts weigh 0
bytes, repeated rows are each assigned (alike), an empty table gives an empty
assignment and leaves the map as it was. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.llm.common import field, name_of, shared_dir, table

SLOTS = 4096
SHARDS = 64


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % slots).cast("int")


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """slot, bytes, records: one row for every slot that has records."""
    key, text = name_of(df, key), name_of(df, text)
    size = F.coalesce(F.octet_length(field(df, text)), F.lit(0)).cast("bigint")
    return (
        df.select(slot_of(field(df, key), slots).alias("slot"), size.alias("size"))
        .groupBy("slot")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))
    )


def initial_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Equal runs of slots: slot, shard."""
    return spark.range(slots).select(
        F.col("id").cast("int").alias("slot"), F.expr(f"cast(id * {shards} div {slots} as int)").alias("shard")
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The edited map: slot, shard, bytes, moved.

    A shard keeps its slots in order of slot while their bytes are within the
    mean; the rest form a pool, in order of shard and slot. A pool slot goes to
    the shard whose gap below the mean covers the slot's middle, gaps laid end to
    end. Bytes are counted in units of 1/(2 * shards), so nothing is rounded. The
    windows without keys run over the slots alone, whose number is fixed.
    """
    m = slot_map.select("slot", "shard").join(loads.select("slot", "bytes"), "slot", "left")
    m = m.select("slot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.expr(f"coalesce(bytes, 0) * {2 * shards}").alias("units"))
    m = m.withColumn("mean", F.expr(f"sum(units) over () div {shards}"))
    m = m.withColumn("upto", F.sum("units").over(W.partitionBy("shard").orderBy("slot")))
    m = m.withColumn("kept", F.col("upto") <= F.col("mean"))
    gaps = m.groupBy("shard").agg(
        F.max("mean").alias("mean"), F.sum(F.expr("case when kept then units else 0 end")).alias("held")
    )
    ids = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    top = m.agg(F.max("mean").alias("all_mean"))
    gaps = ids.join(gaps, "shard", "left").crossJoin(F.broadcast(top)).select(
        F.col("shard").alias("to"), F.expr("all_mean - coalesce(held, 0)").alias("gap")
    )
    gaps = gaps.withColumn("hi", F.sum("gap").over(W.orderBy("to")))
    gaps = gaps.select("to", (F.col("hi") - F.col("gap")).alias("lo"), "hi").where("hi > lo")
    pool = m.where("not kept").withColumn("mid", F.sum("units").over(W.orderBy("shard", "slot")) - F.expr("units div 2"))
    found = pool.join(F.broadcast(gaps), (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi")), "left")
    return m.join(F.broadcast(found.select("slot", "to")), "slot", "left").select(
        "slot",
        F.coalesce("to", "shard").alias("shard"),
        "bytes",
        (F.col("to").isNotNull() & (F.col("to") != F.col("shard"))).alias("moved"),
    )


class MapStore:
    """Versions of a slot map as Parquet folders under a path, which may hold those
    of earlier sessions. A version is never rewritten: it is written aside and then
    renamed, which fails if another session has written that version meanwhile."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark) + "/slot_map"
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str = ""):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        fs = self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._at()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._at())]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def save(self, slot_map: DataFrame) -> int:
        """The number of the new version."""
        version = max(self.versions(), default=0) + 1
        aside = f".new-{uuid.uuid4().hex}"
        slot_map.coalesce(1).write.parquet(f"{self.path}/{aside}")
        gateway = self.spark.sparkContext._gateway
        context = self.hadoop.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._at(aside), self._at(f"v={version}"), gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return version

    def load(self, version: int | None = None) -> DataFrame:
        """That version, or the last."""
        if version is None:
            version = max(self.versions(), default=0)
        return self.spark.read.parquet(f"{self.path}/v={version}")


def assign(df: DataFrame, slot_map: DataFrame, version: int, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """key, slot, shard, moved, map_version of every record. The map has a fixed
    number of rows, so it is broadcast."""
    key = name_of(df, key)
    m = slot_map.select("slot", "shard", "moved")
    return (
        df.select(field(df, key).alias("key"), slot_of(field(df, key), slots).alias("slot"))
        .join(F.broadcast(m), "slot")
        .select(F.col("key").alias(key), "slot", "shard", "moved", F.lit(version).alias("map_version"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = MapStore(spark)
    store.save(initial_map(spark))
    version = store.save(rebalance(store.load(), slot_bytes(docs)))
    return assign(docs, store.load(), version)


SQL = f"""
with d as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) % {SLOTS} as slot,
                  coalesce(strlen(text), 0) as bytes from documents),
loads as (select slot, sum(bytes) as bytes from d group by slot),
m as (select r.slot, r.slot * {SHARDS} // {SLOTS} as shard, coalesce(l.bytes, 0)::hugeint * {2 * SHARDS} as units
      from range({SLOTS}) r(slot) left join loads l using (slot)),
k as (select *, sum(units) over () // {SHARDS} as mean,
             sum(units) over (partition by shard order by slot rows unbounded preceding) as upto from m),
g as (select s.shard as dest, max(t.mean) - coalesce(sum(case when k.upto <= k.mean then k.units else 0 end), 0) as gap
      from range({SHARDS}) s(shard) left join k using (shard) cross join (select max(mean) as mean from k) t group by s.shard),
h as (select dest, sum(gap) over (order by dest rows unbounded preceding) as hi, gap from g),
p as (select slot, shard, sum(units) over (order by shard, slot rows unbounded preceding) - units // 2 as mid from k where upto > mean),
f as (select p.slot, h.dest from p left join h on h.gap > 0 and p.mid >= h.hi - h.gap and p.mid < h.hi),
e as (select m.slot, coalesce(f.dest, m.shard) as shard, coalesce(f.dest <> m.shard, false) as moved from m left join f using (slot))
select d.doc_id, cast(d.slot as int) as slot, cast(e.shard as int) as shard, e.moved, 2 as map_version from d join e using (slot)
"""
