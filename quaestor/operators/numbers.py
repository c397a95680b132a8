"""Claimed numbers against facts: a join by bands of magnitude, values derived from pairs of facts, and a checker's verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions import numeric as N

#: Columns of a fact.
FACT = ["ticker", "fiscal_year", "concept", "value", "unit"]


def _band(x: Column, tolerance: float) -> Column:
    """The number of a value's band: bands are as wide as the tolerance, in logarithms; null for zero."""
    width = max(-math.log1p(-tolerance), 1e-9) * (1 + 1e-9)
    return F.when(x != 0, F.floor(F.log(F.abs(x)) / width))


def band_join(claims: DataFrame, values: DataFrame, keys: list[str], claimed: str, value: str, tolerance: float) -> DataFrame:
    """Rows of claims with the rows of values of equal keys for which |claimed - value| <= tolerance * |value|.

    A value stands in the band of its sign and logarithm; a claim asks in its own and both neighbours, as the tolerance
    is a band's width, so each pair meets once and only near ones meet. Zero is only near zero. The join's key has the
    band, so that a key with many values is spread. Null, NaN and infinite numbers are near nothing. The tolerance is under 1.
    """
    if not 0 <= tolerance < 1:
        raise ValueError("a tolerance is at least 0 and under 1")
    c, v = F.col(claimed), F.col(value)
    near = F.when(c == 0, F.array(F.lit(None).cast("long"))).otherwise(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: _band(c, tolerance) + i))
    asks = claims.where(N.finite(c)).select("*", F.signum(c).alias("_sign"), F.explode(near).alias("_near")).withColumn("_near", F.coalesce("_near", F.lit(0).cast("long")))
    held = values.where(N.finite(v)).select("*", F.signum(v).alias("_sign"), F.coalesce(_band(v, tolerance), F.lit(0).cast("long")).alias("_near"))
    return asks.join(held, [*keys, "_sign", "_near"]).where(N.within_one_sided(c, v, tolerance)).drop("_sign", "_near")


def derived(facts: DataFrame, group: list[str]) -> DataFrame:
    """Values of ordered pairs of different facts of one group and company: (group, ticker, kind, first, second, derived).

    difference: first - second, change: in percent of second, both of one concept; ratio: first in percent of second, of
    one year and two concepts. None from a second value of zero but the difference. first and second are year and concept.
    """
    name = F.concat_ws("/", F.col("fiscal_year").cast("string"), "concept")
    side = lambda s: facts.select(*group, "ticker", F.struct("fiscal_year", "concept", "value", "unit", name.alias("name")).alias(s), F.col("fiscal_year").alias(f"{s}_year"), F.col("concept").alias(f"{s}_concept"))
    a, b = F.col("a.value"), F.col("b.value")
    same = side("a").withColumnRenamed("a_concept", "concept").join(side("b").withColumnRenamed("b_concept", "concept"), [*group, "ticker", "concept"]).where("NOT a <=> b")
    year = side("a").withColumnRenamed("a_year", "year").join(side("b").withColumnRenamed("b_year", "year"), [*group, "ticker", "year"]).where("a_concept <> b_concept")
    out = [*group, "ticker"]
    pair = lambda kind, x: (F.lit(kind).alias("kind"), F.col("a.name").alias("first"), F.col("b.name").alias("second"), x.alias("derived"))
    rows = same.select(*out, *pair("difference", a - b)).unionAll(same.select(*out, *pair("change", F.try_divide(a - b, b) * 100))).unionAll(year.select(*out, *pair("ratio", F.try_divide(a, b) * 100)))
    return rows.where("derived IS NOT NULL")


def check(answers: DataFrame, consulted: DataFrame, facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """What is to be said of each answer's number: (question_id, verdict, fact, unit).

    answers: (question_id, claimed, ticker, fiscal_year, unit, corrected), one row for each question; ticker, year and unit
    may be null, corrected says that it was sent back before. consulted: (question_id, FACT), the facts that the
    question's calls asked for. facts: FACT, all there are. A blank ticker counts as none; tickers are trimmed and upper-cased.

    no_number; match: a consulted fact of the declared company and year (each if declared) is near; unit_normalised: the
    same, and all such facts have one unit, which isn't the declared one: `unit` is theirs; derived: a difference, change or
    ratio of two consulted facts is near; kept: none of these after a correction; rounded: a consulted fact of the
    declared identity isn't whole and the claim is it rounded; other_identity: a consulted fact of another company
    or year is near; no_facts: company and year are declared and have none; unconsulted: a fact of both is near that wasn't
    asked for; no_match. `fact` names the least fact (by company, year, concept) that the verdict is about, else it is null.
    """
    text = lambda c: F.upper(F.trim(c))
    asked = answers.select("question_id", "claimed", F.nullif(text(F.col("ticker")), F.lit("")).alias("said_ticker"), F.col("fiscal_year").alias("said_year"), F.col("unit").alias("said_unit"), "corrected")
    known = consulted.select("question_id", text(F.col("ticker")).alias("ticker"), "fiscal_year", "concept", "value", F.coalesce("unit", F.lit("")).alias("unit")).distinct()
    every = facts.select(text(F.col("ticker")).alias("ticker"), "fiscal_year", "concept", "value", F.coalesce("unit", F.lit("")).alias("unit"))
    name = F.concat_ws("/", "ticker", F.col("fiscal_year").cast("string"), "concept")
    mine = (F.col("said_ticker").isNull() | (F.col("said_ticker") == F.col("ticker"))) & (F.col("said_year").isNull() | (F.col("said_year") == F.col("fiscal_year")))
    order = F.struct("ticker", "fiscal_year", "concept", name.alias("name"))

    near = band_join(asked, known, ["question_id"], "claimed", "value", tolerance).withColumn("mine", mine)
    near = near.groupBy("question_id").agg(
        F.min(F.when(F.col("mine"), order))["name"].alias("matched"), F.min(F.when(F.col("mine"), F.col("unit"))).alias("unit_from"), F.max(F.when(F.col("mine"), F.col("unit"))).alias("unit_to"), F.min(F.when(~F.col("mine"), order))["name"].alias("other"))
    made = band_join(asked, derived(known, ["question_id"]), ["question_id"], "claimed", "derived", tolerance).select("question_id").distinct().withColumn("made", F.lit(True))
    whole = known.where("value <> floor(value)").withColumn("claimed", F.bround("value"))
    rounded = asked.join(whole, ["question_id", "claimed"]).where(mine).groupBy("question_id").agg(F.min(order)["name"].alias("rounded"))
    there = every.select(F.col("ticker").alias("said_ticker"), F.col("fiscal_year").alias("said_year")).distinct().withColumn("there", F.lit(True))
    unread = band_join(asked, every.select("*", F.col("ticker").alias("said_ticker"), F.col("fiscal_year").alias("said_year")), ["said_ticker", "said_year"], "claimed", "value", tolerance)
    unread = unread.join(known, ["question_id", *FACT], "left_anti").groupBy("question_id").agg(F.min(order)["name"].alias("unread"))

    out = asked
    for part in (near, made, rounded, unread):
        out = out.join(part, "question_id", "left")
    out = out.join(there, ["said_ticker", "said_year"], "left")
    declared, one = F.lower(F.trim(F.coalesce("said_unit", F.lit("")))), F.col("unit_from") == F.col("unit_to")
    verdict = (
        F.when(~N.finite(F.col("claimed")) | F.col("claimed").isNull(), "no_number").when(F.col("matched").isNotNull() & one & (declared != F.lower("unit_from")), "unit_normalised").when(F.col("matched").isNotNull(), "match")
        .when(F.col("made"), "derived").when(F.col("corrected"), "kept").when(F.col("rounded").isNotNull(), "rounded").when(F.col("other").isNotNull(), "other_identity")
        .when(F.col("said_ticker").isNotNull() & F.col("said_year").isNotNull() & F.col("there").isNull(), "no_facts").when(F.col("unread").isNotNull(), "unconsulted").otherwise("no_match")
    )
    out = out.withColumn("verdict", verdict)
    fact = F.when(F.col("verdict").isin("match", "unit_normalised"), F.col("matched")).when(F.col("verdict") == "rounded", F.col("rounded")).when(F.col("verdict") == "other_identity", F.col("other")).when(F.col("verdict") == "unconsulted", F.col("unread"))
    return out.select("question_id", "verdict", fact.alias("fact"), F.when(F.col("verdict") == "unit_normalised", F.col("unit_from")).otherwise(F.col("said_unit")).alias("unit"))
