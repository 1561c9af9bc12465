"""Sharding by a weighted hash tree: region, rack and shard are drawn one after another.

At each level every child draws a number from the row's key and its own name, divided by its
weight, and the smallest draw wins. A draw depends on nothing else, so when a weight changes
rows move only into or out of the subtrees whose weights change. A further shard gets a region
of its own, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import settled, shuffle_partitions, unused


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 4, base: int = 24) -> tuple[Shard, ...]:
    """Shards 0 to shards - 1: up to `base` fill regions of `racks` racks in turn, each further one is its own region."""
    out = []
    for s in range(shards):
        if s < base:
            rack, region = s // per_rack, s // (per_rack * racks)
            out.append(Shard(s, f"region{region}", f"region{region}/rack{rack % racks}"))
        else:
            out.append(Shard(s, f"region+{s}", f"region+{s}/rack0"))
    return tuple(out)


def draw(key: Column, name: Column, weight: Column) -> Column:
    """Exponential with the weight as its rate: 52 bits of a digest of key and name, as a number over 0 and under 1."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def _winner(key: Column, children: Column) -> Column:
    drawn = F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _children(pairs: dict[str, float]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(pairs.items()) if w > 0))


def _by_parent(shards: tuple[Shard, ...], parent: str, name) -> Column:
    """A map from each parent to its children with the sums of their weights."""
    held: dict[str, dict[str, float]] = {}
    for s in shards:
        own = held.setdefault(getattr(s, parent), {})
        own[name(s)] = own.get(name(s), 0.0) + s.weight
    return F.create_map(*(x for p, own in sorted(held.items()) for x in (F.lit(p), _children(own))))


def with_shard(df: DataFrame, key: Column, shards: tuple[Shard, ...], shard: str = "shard") -> DataFrame:
    """Adds the shard of each row, which the key and the tree decide. A null key is a key like any other.

    Nothing is moved. Other columns stay; one named as `shard` is replaced.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions: dict[str, float] = {}
    for s in shards:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
    region = _winner(key, _children(regions))
    drawn_region, drawn_rack = unused(df, "drawn region", "drawn rack")
    rack = _winner(key, F.element_at(_by_parent(shards, "region", lambda s: s.rack), F.col(drawn_region)))
    leaf = _winner(key, F.element_at(_by_parent(shards, "rack", lambda s: f"{s.rack}/shard{s.number}"), F.col(drawn_rack)))
    out = df.withColumn(drawn_region, region).withColumn(drawn_rack, rack)
    out = out.withColumn(shard, F.substring_index(leaf, "/shard", -1).cast("int"))
    return out.drop(drawn_region, drawn_rack)


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds places from 0 without gaps within each shard, by the order columns (nulls first).

    Rows are ranged by shard and order over all tasks, written once, ranked within each range
    and shard, and lifted by the counts of the ranges before: no shard meets in one task.
    """
    spark = df.sparkSession
    before, rank, part, rows = unused(df, "before", "rank", "range", "rows")
    ranged = settled(settled(df).repartitionByRange(shuffle_partitions(spark), shard, *order)).withColumn(part, F.spark_partition_id())
    counts = ranged.groupBy(shard, part).agg(F.count(F.lit(1)).alias(rows))
    # one row for each shard and range
    sums = counts.select(shard, part, (F.sum(rows).over(_window([shard], [part])) - F.col(rows)).alias(before))
    ranked = ranged.withColumn(rank, F.row_number().over(_window([shard, part], order)))
    return ranked.join(sums, [shard, part]).withColumn(slot, (F.col(before) + F.col(rank) - 1).cast("long")).drop(before, rank, part)


def _window(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*(F.col(c).asc_nulls_first() for c in order))


def assign(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) by the law `key`: id and number of shards decide.

    size: UTF-8 bytes of the text, none for null, and 8. The crc of a null text is that of an
    empty one. grown_shard is the shard with one more: the same, or the new one. Rows without
    id are of one key; repeated rows share a shard and have slots of their own. An empty table
    gives an empty result.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), F.lit("key").alias("law"))
    rows = with_shard(rows, F.col("doc_id"), tree(shards))
    rows = with_shard(rows, F.col("doc_id"), tree(shards + 1), "grown_shard")
    out = with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select(F.col("doc_id").alias(doc_id), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
