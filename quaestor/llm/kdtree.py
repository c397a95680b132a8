"""Shards by a k-d tree over document metadata: recursive splits at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, with_offsets

#: A group of equal texts with more than this share of a shard's target is dealt by itself; so there are at most
#: shards * HEAVY of them, however many rows there are.
HEAVY = 32
#: A median is found in two passes over histograms of so many bins for each node; 2 ** 20 places in all.
BINS = 1024
#: Length, language, source.
DIMENSIONS = ["d0", "d1", "d2"]


def _dimensions(docs: DataFrame) -> DataFrame:
    """A row for each different text: its digest, weight (bytes and 1 for each row), and its metadata as numbers from 0 to 1.

    Length on a log scale between the shortest and the longest; language and source by hash. A group takes the least
    language and source of its rows. A null text is a group of its own.
    """
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) / float(1 << 30)
    groups = docs.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("n_rows"), F.min("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    sizes = docs.agg(F.min("size"), F.max("size")).first()
    low, high = (float(x or 1) for x in sizes)
    length = (F.log2("size") - F.log2(F.lit(low))) / F.log2(F.lit(high / low)) if high > low else F.lit(0.0)
    return groups.select("digest", "weight", "n_rows", length.alias("d0"), unit("lang").alias("d1"), unit("source").alias("d2"))


def _widest(nodes: DataFrame, dims: list[str]) -> DataFrame:
    """For each node its widest dimension and where that begins and ends; ties go to the first."""
    ranges = nodes.groupBy("node").agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))))
    width = F.greatest(*(F.struct((F.col(f"hi_{d}") - F.col(f"lo_{d}")).alias("width"), F.lit(-i).alias("rank"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for i, d in enumerate(dims)))
    return ranges.select("node", width.alias("w")).select("node", F.col("w.rank").alias("rank"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))


def _cut(nodes: DataFrame, place: Column, want: str) -> DataFrame:
    """For each node the bin in which the running weight passes `want`, and the weight before it: (node, cut, before)."""
    bins = nodes.groupBy("node", place.alias("bin")).agg(F.sum("weight").alias("weight"), F.first(want).alias("want"))
    run = Window.partitionBy("node").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("weight").over(run)).withColumn("before", F.col("upto") - F.col("weight"))
    return bins.where("upto > want").groupBy("node").agg(F.min_by(F.struct("bin", "before"), "bin").alias("c")).select("node", F.col("c.bin").alias("cut"), F.col("c.before").alias("before"))


def _split(nodes: DataFrame, dims: list[str], share: dict[int, float]) -> DataFrame:
    """Cuts each node in two along its widest dimension: `node` becomes 2 * node, or 2 * node + 1 from the median on.

    share: of each node's weight, the part that is wanted on the left. Places on the dimension are first dealt to
    bins; the bin with the median is then cut by the digest's hash, so that many equal values don't stay together.
    """
    total = nodes.groupBy("node").agg(F.sum("weight").alias("total"))
    left = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))
    widest = _widest(nodes, dims).join(total, "node").withColumn("want", F.col("total") * left[F.col("node")])
    at = F.coalesce(*(F.when(F.col("rank") == -i, F.col(d)) for i, d in enumerate(dims)))
    scaled = F.when(F.col("hi") > F.col("lo"), (at - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    # at most one row for each node: 2 ** level of them
    placed = nodes.join(F.broadcast(widest), "node").withColumn("bin", F.least(F.floor(scaled * BINS), F.lit(BINS - 1)).cast("int")).withColumn("fine", F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(BINS)).cast("int"))
    first = _cut(placed, F.col("bin"), "want")
    inside = placed.join(F.broadcast(first), "node").where("bin = cut").withColumn("rest", F.col("want") - F.col("before")).drop("before")
    second = _cut(inside.drop("cut"), F.col("fine"), "rest").select("node", F.col("cut").alias("fine_cut"))
    cuts = first.join(second, "node", "left")
    right = F.coalesce((F.col("bin") > F.col("cut")) | ((F.col("bin") == F.col("cut")) & (F.col("fine") >= F.col("fine_cut"))), F.lit(False))
    return placed.join(F.broadcast(cuts), "node", "left").select("digest", "weight", "n_rows", *dims, (2 * F.col("node") + right.cast("int")).alias("node"))


def shard(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """For each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) and 1. The law is `bytes`: shards of nearly equal size, with equal texts
    in one shard. shards is a power of two, else ValueError. slot counts a shard's rows from 0 without gaps. Null and empty texts are
    groups like others; the checksum of a null text is 0, as of an empty one. Repeated rows take slots of their own.

    Groups of equal texts are points with a weight. Each level of the tree cuts all its nodes at the weighted median
    of their widest metadata dimension, found by histograms, until a node is one shard's target. A group too heavy
    for a fine median is dealt first, to the shard with the least so far, and its weight counts towards the share
    that its side of each cut takes.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    levels = (shards - 1).bit_length()
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    rows = docs.select("doc_id", "lang", "source", F.sha2(F.concat(F.when(F.col(text).isNull(), F.lit(b"0")).otherwise(F.lit(b"1")), raw), 256).alias("digest"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = store(rows, "sizes")
    groups = store(_dimensions(rows), "groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    heavy = groups.where(F.col("weight") * shards * HEAVY > total).select("digest", "weight").orderBy(F.desc("weight"), "digest").collect()
    load, placed = [0] * shards, []
    for digest, weight in heavy:  # at most shards * HEAVY, as together they weigh no more than all
        i = min(range(shards), key=lambda k: (load[k], k))
        load[i] += weight
        placed.append((digest, i))
    own = groups.sparkSession.createDataFrame(placed, "digest string, node int")
    target = total / shards
    light = groups.join(F.broadcast(own), "digest", "left_anti").withColumn("node", F.lit(0))
    for level in range(levels):
        room = lambda node, depth: sum(max(0.0, target - x) for i, x in enumerate(load) if i >> (levels - depth) == node)
        share = {n: room(2 * n, level + 1) / (room(n, level) or 1.0) for n in range(1 << level)}
        light = store(_split(light, DIMENSIONS, share), "nodes")
    dealt = light.select("digest", "node").unionAll(own).withColumnRenamed("node", "shard")
    out = rows.join(dealt, "digest").withColumn("one", F.lit(1))
    out = with_offsets(out, "shard", ["doc_id", "digest"], "one", rows.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("start").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
