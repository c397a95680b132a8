"""Exact percentiles by histograms that are refined, so that no key's values meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.sources.tables import stored

#: Bins of a histogram; values of a bin that are few enough to be sorted.
BINS, FEW = 512, 5_000


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, percentile): by the linear rule between the two values that stand around share * (n - 1).

    Each of these ranks is looked for in a histogram of the values between two bounds, counted before the shuffle; the bin
    that holds it gives the next bounds, until it has one value or FEW. Null keys are a key; null, NaN and infinite
    values are left out, and a key without others has no row.
    """
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("a share is from 0 to 1")
    v = df.select(F.struct(*keys).alias("key"), F.col(value).cast("double").alias("v")).where(N.finite(F.col("v")))
    base = v.groupBy("key").agg(F.count("*").alias("n_in"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = base.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in sorted(set(shares)))))).withColumn("place", F.col("share") * (F.col("n_in") - 1))
    asked = stored(asked, "asked")
    need = asked.select("key", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n_in").distinct()
    columns = ["key", "rank", "low", "high", "before", "n_in"]
    need = stored(need.select(*columns), "ranks")
    wide = F.col("high") / BINS - F.col("low") / BINS
    inside = F.least(F.floor(F.try_divide(F.col("v"), F.col("wide")) - F.try_divide(F.col("low"), F.col("wide"))), F.lit(BINS - 1))
    while need.where((F.col("low") < F.col("high")) & (F.col("n_in") > FEW)).limit(1).count():
        open_ = need.where((F.col("low") < F.col("high")) & (F.col("n_in") > FEW)).withColumn("wide", wide)
        rows = v.join(open_, "key").where("v BETWEEN low AND high")
        # the least and the greatest value are never in one bin, so that each round leaves less
        at = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), BINS).otherwise(F.greatest(F.coalesce(inside, F.lit(0)), F.lit(0))).cast("int")
        bins = rows.groupBy("key", "rank", "before", at.alias("bin")).agg(F.count("*").alias("n_in"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n_in").over(Window.partitionBy("key", "rank").orderBy("bin"))
        hit = bins.withColumn("before", F.col("before") + upto - F.col("n_in")).where("before <= rank AND rank < before + n_in")
        need = stored(need.where("low = high OR n_in <= " + str(FEW)).select(*columns).unionAll(hit.select(*columns)), "ranks")
    few = v.join(need.where("low < high"), "key").where("v BETWEEN low AND high")
    place = F.col("before") + F.row_number().over(Window.partitionBy("key", "rank").orderBy("v")) - 1
    found = need.where("low = high").select("key", "rank", F.col("low").alias("v")).unionAll(few.withColumn("place", place).where("place = rank").select("key", "rank", "v"))
    end = lambda name: found.select("key", F.col("rank").alias(f"rank_{name}"), F.col("v").alias(name))
    out = asked.withColumn("rank_a", F.floor("place")).withColumn("rank_b", F.ceil("place")).join(end("a"), ["key", "rank_a"]).join(end("b"), ["key", "rank_b"])
    return out.select("key.*", "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("percentile"))
