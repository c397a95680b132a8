"""Mixing sources to target weights: token blocks, multinomial draws per output shard, pseudorandom permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, with_offsets, word_count

#: Words in a block, blocks in an output shard, rounds of a permutation, intervals of a lookup by number.
BLOCK, SHARD, ROUNDS, BUCKETS = 64, 4096, 8, 4096
#: Weights of the sources in turn, and how many times its size a source's target may be.
WEIGHTS, CAP = (5, 2, 1), 3


def draw(*what) -> Column:
    """A pseudorandom number of 48 bits that the arguments fix; any SQL with MD5 can give it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in what))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each source: src (its place by code point, from 1, null last), source_size, target, and its blocks and slots.

    The targets share the sum of all sizes by weight; those above CAP times their size stop there and the others share
    the excess by weight. With sources in order of cap by weight, the level (target by weight of those not stopped) is
    the highest that any number of stopped ones in that order leaves. One row for each source goes through one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.col("src") - 1) % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", CAP * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    stopped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("source_size").over(Window.partitionBy()) - stopped) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    # whole epochs, and so many blocks that the rest comes near the target
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.least(F.col("blocks"), F.floor((F.col("target") - whole * F.col("source_size")) / block + 0.5)).cast("long")
    by = by.withColumn("slots", whole * F.col("blocks") + rest)
    upto = F.sum("slots").over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0))
    return by.select("source", "src", "source_size", "target", "blocks", "slots", (upto - F.col("slots")).alias("low"), upto.alias("high"))


def _within(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, total: int) -> DataFrame:
    """Each row of points with the row of disjoint ranges that it lies in, by an equal-width bucket of its number."""
    width = max(1, -(-total // BUCKETS))
    split = ranges.where(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(split, "_b").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")


def permuted(index: Column, blocks: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. blocks - 1 puts an index: rounds of swap-or-not, one for each key."""

    def step(at: Column, turn: Column) -> Column:
        pivot = F.pmod(F.pmod(draw("pivot", *key, turn), blocks) - at, blocks)
        swap = F.substring(F.md5(F.concat_ws("|", F.lit("swap"), *(k.cast("string") for k in key), turn.cast("string"), F.greatest(at, pivot).cast("string"))), 1, 1) < "8"
        return F.when(swap, pivot).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def plan(sources: DataFrame, seed: int = 17, shard: int = SHARD) -> DataFrame:
    """The mix as slots: (shard, src, slot, epoch, block), slot counting a source's own slots from 0.

    Each place of a shard draws a source by its part of all slots, which gives the shard multinomial counts. Summed
    over shards these miss what each source should have by chance; draws beyond a source's slots, the last ones, go to
    the sources that fell short, in order of shards' hashed chunks. A slot's epoch and index then give its block through the source's
    permutation of that epoch, so a block comes as often as there are whole epochs, or once more.
    """
    spark = sources.sparkSession
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    places = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(draw("slot", F.lit(seed), F.col("id")), F.lit(max(1, total))).alias("u"))
    counts = _within(places, "u", sources, "low", "high", total).groupBy("shard", "src").agg(F.count("*").alias("n"), F.first("slots").alias("slots"))
    counts = store(counts, "draws")
    n_counts = counts.count()
    counts = with_offsets(counts, "src", ["shard"], "n", n_counts).withColumnRenamed("start", "from").withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("from"))))
    # draws to hand on and to hand out, as numbers in one line for all sources
    drawn = sources.join(counts.groupBy("src").agg(F.sum("n").alias("drawn")), "src", "left").withColumn("over", F.coalesce("drawn", F.lit(0)) - F.col("slots"))
    line = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda c: F.coalesce(F.sum(c).over(line), F.lit(0))
    drawn = drawn.select("src", part(F.greatest("over", F.lit(0))).alias("over_low"), part(F.greatest(-F.col("over"), F.lit(0))).alias("short_low"), F.greatest(-F.col("over"), F.lit(0)).alias("short"), F.greatest("over", F.lit(0)).alias("over"))
    drawn = store(drawn, "surplus")
    moved = int(drawn.agg(F.sum("over")).first()[0] or 0)
    extra = counts.where("n > keep").join(drawn.select("src", "over_low"), "src")
    extra = extra.withColumn("first", F.col("over_low") + F.greatest(F.lit(0), F.col("from") - F.col("slots")))
    extra = extra.select("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - F.col("keep") - 1)).alias("u"))
    short = drawn.where("short > 0").select("src", "short_low", (F.col("short_low") + F.col("short")).alias("short_high"))
    extra = _within(extra, "u", short, "short_low", "short_high", moved).groupBy("shard", "src").agg(F.count("*").alias("n"))
    settled = counts.select("shard", "src", F.col("keep").alias("n")).unionAll(extra).groupBy("shard", "src").agg(F.sum("n").alias("n")).where("n > 0")
    settled = with_offsets(settled, "src", ["shard"], "n", n_counts).withColumnRenamed("start", "from")
    # the draws are few and small; what they stand for is work for many tasks
    settled = settled.join(sources.select("src", "blocks"), "src").repartition(max(spark.sparkContext.defaultParallelism, min(20_000, total // 25_000)), "shard", "src")
    slots = settled.select("shard", "src", "blocks", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("slot"))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    return slots.select("shard", "src", "slot", "epoch", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("src"), F.col("epoch")).alias("block"))


def _pieces(placed: DataFrame, block: int) -> DataFrame:
    """The parts of blocks that rows with a start and a size in their source's stream fill: block, first (word in the row), words."""
    at = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    return at.withColumn("first", first).withColumn("words", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")) - first)


def taken(docs: DataFrame, seed: int = 17, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken (words that the mix takes from it, repeats counted).

    size is the text's number of words (null: 0). A source's words, its documents one after another, are packed into
    blocks of `block` words; plan() says how often each is taken. The order of documents, the draws and the
    permutations hang on ids, sizes and the seed alone, so reruns agree. No block is taken over CAP times. Repeated
    rows have places of their own; of rows with an equal id, source and size either may have either place.
    """
    sizes = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = store(targets(sizes, block), "sources")
    times = plan(sources, seed, shard).groupBy("src", "block").agg(F.count("*").alias("times"))
    rows = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "size", "src", "source_size", "target")
    placed = store(with_offsets(rows, "src", ["doc_id", "size"], "size", sizes.count()), "places")
    part = _pieces(placed, block).join(times, ["src", "block"]).groupBy("src", "start", "size", "doc_id").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    same = (F.col("p.size") > 0) & (F.col("p.src") == F.col("t.src")) & (F.col("p.start") == F.col("t.start"))
    return placed.alias("p").join(part.alias("t"), same, "left").select("p.doc_id", "p.size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 17, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as documents: docs' columns, text cut to the words taken; a row for each time that any of them is taken.

    The row of the n-th time has the words of all blocks that are taken n times or more, with the white space before
    each but the first, and n_chars says its length. Texts without taken words have no row.
    """
    names = docs.columns
    sized = docs.withColumn("size", word_count(F.col("text")))
    sources = store(targets(sized.select("source", "size"), block), "sources")
    times = plan(sources, seed, shard).groupBy("src", "block").agg(F.count("*").cast("int").alias("times"))
    keyed = sized.join(sources.select(F.col("source").alias("_source"), "src"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = store(with_offsets(keyed, "src", ["doc_id", "size"], "size", docs.count()).where("size > 0"), "placed")
    part = _pieces(placed.select("src", "start", "size"), block).join(times, ["src", "block"])
    part = part.groupBy("src", "start").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("parts"))
    # units before the explode: so they are found once for a row, not once for each part
    units = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole = placed.join(part, ["src", "start"]).withColumn("units", units).withColumn("n", F.explode(F.sequence(F.lit(1), F.array_max("parts.times"))))
    cut = F.transform(F.filter("parts", lambda p: p["times"] >= F.col("n")), lambda p: F.array_join(F.slice("units", (p["first"] + 1).cast("int"), p["words"].cast("int")), ""))
    whole = whole.withColumn("text", F.regexp_replace(F.array_join(cut, ""), r"^[\x20\x09-\x0D]+", ""))
    if "n_chars" in names:
        whole = whole.withColumn("n_chars", F.length("text").cast("long"))
    return whole.select(*names)
