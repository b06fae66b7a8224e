"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` slots; each shard owns ``VNODES`` points on it. A key hashes to a slot and belongs to the
first point clockwise. Under the law ``rows`` every shard has a capacity, the even share of all rows (so counts
differ by one at most), and keys that overflow a full shard continue clockwise to the next shard with room: in
round r all unplaced keys of a slot, in slot order, ask their r-th shard. Only the counts by slot are needed to
decide that, so what reaches the driver is bounded by the ring and not by the data; a key then finds its shard
from its rank within its slot. Under the law ``key`` nothing is bounded: the key and the number of shards decide.

Ranks come from two steps, within (slot, lane) and over a slot's lanes, so that a key with very many rows is not
ordered in one task; which of several equal rows gets which rank makes no difference. What ranks rest on is
written to the shared folder first, so a lost executor cannot change it.

Defined cases: a null text has no bytes (size 1, CRC 0); null keys hash like any value; repeated rows are placed
each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

SLOTS, VNODES, LANES = 1024, 64, 32


def preferences(spark: SparkSession, shards: int) -> list[list[int]]:
    """For each slot the shards in clockwise order. At most shards * VNODES points are collected."""
    points = spark.range(shards * VNODES).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64((F.col("id") % shards), F.floor(F.col("id") / shards), F.lit("point")).alias("h"))
    at: list[list[tuple[int, int]]] = [[] for _ in range(SLOTS)]
    for r in points.collect():
        at[r["h"] % SLOTS].append((r["h"], r["shard"]))
    out = []
    for slot in range(SLOTS):
        order: list[int] = []
        for step in range(SLOTS):
            for _, shard in sorted(at[(slot + step) % SLOTS]):
                if shard not in order:
                    order.append(shard)
            if len(order) == shards:
                break
        out.append(order)
    return out


def quotas(counts: dict[int, int], order: list[list[int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, place of the first) for keys counted by slot, loads differing by one at most."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, begun, out = [0] * shards, dict.fromkeys(counts, 0), []
    for r in range(shards):
        for slot in sorted(counts):
            shard = order[slot][r]
            take = min(counts[slot] - begun[slot], room[shard] - used[shard])
            if take > 0:
                out.append((slot, begun[slot], begun[slot] + take, shard, used[shard]))
                begun[slot] += take
                used[shard] += take
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    h = F.xxhash64(F.col("id").cast("string"), F.lit("key"))
    return df.withColumns({"h": h, "ring": F.pmod(h, F.lit(SLOTS)).cast("int"), "lane": (F.monotonically_increasing_id() % LANES).cast("int")})


def _ranked(keys: DataFrame, group: str) -> DataFrame:
    """Adds ``rank``, gapless from 0 within ``group``."""
    lanes = keys.groupBy(group, "lane").agg(F.count("*").alias("n"))
    lanes = lanes.withColumn("before", F.sum("n").over(W.partitionBy(group).orderBy("lane").rowsBetween(W.unboundedPreceding, -1)))
    own = keys.withColumn("own", F.row_number().over(W.partitionBy(group, "lane").orderBy("h", "id", "size", "crc")) - 1)
    return own.join(lanes.select(group, "lane", F.coalesce("before", F.lit(0)).alias("before")), [group, "lane"]).withColumn("rank", F.col("own") + F.col("before"))


def shard(docs: DataFrame, shards: int = 8, law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless within a shard) and ``grown_shard`` of each document."""
    spark = docs.sparkSession
    keys = Scratch(spark).table(_keyed(docs, id_col, text_col), "keys")
    if law == "key":
        now, then = ([o[0] for o in preferences(spark, n)] for n in (shards, shards + 1))
        pick = lambda owners: F.element_at(F.array(*map(F.lit, owners)), F.col("ring") + 1).cast("int")
        placed = _ranked(keys.withColumns({"shard": pick(now), "grown_shard": pick(then)}), "shard").withColumn("slot", F.col("rank"))
    elif law == "rows":
        counts = {r["ring"]: r["count"] for r in keys.groupBy("ring").count().collect()}  # a row for each slot at most
        spans = spark.createDataFrame(quotas(counts, preferences(spark, shards), shards), "ring int, lo long, hi long, shard int, first long")
        by_ring = spans.groupBy("ring").agg(F.collect_list(F.struct("lo", "hi", "shard", "first")).alias("spans"))  # one for each shard at most
        placed = _ranked(keys, "ring").join(F.broadcast(by_ring), "ring")
        span = F.filter("spans", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
        placed = placed.withColumn("span", span).withColumns({"shard": F.col("span.shard"), "slot": F.col("span.first") + F.col("rank") - F.col("span.lo"), "grown_shard": F.lit(None).cast("int")})
    else:
        raise ValueError("law is rows or key")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
