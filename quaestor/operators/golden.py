"""Rules that golden cases must keep, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor import schemas
from quaestor.functions import numeric as N
from quaestor.sources import jsonl

# Fixed values.
FAMILIES = ("extractiva", "numerica", "comparativa")
ANCHOR_WORDS = 40


def problems() -> Column:
    """An array of codes for what is wrong with a case's own fields; empty if nothing is."""
    family = F.col("familia")
    number = F.col("concept_xbrl").isNotNull() | F.col("cifra_esperada").isNotNull() | F.col("unidad").isNotNull()
    unanchored = F.col("item_esperado").isNull() | F.col("ancla_texto").isNull() | F.col("ancla_inicio").isNull() | F.col("ancla_fin").isNull()
    span = F.col("ancla_fin") - F.col("ancla_inicio")
    rules = {
        "concept_missing": (family != "extractiva") & F.col("concept_xbrl").isNull(),
        "number_without_unit": (family != "extractiva") & (F.col("cifra_esperada").isNull() != F.col("unidad").isNull()),
        "number_not_allowed": (family == "extractiva") & number,
        "anchor_missing": (family != "numerica") & unanchored,
        "anchor_not_allowed": (family == "numerica") & (F.col("item_esperado").isNotNull() | F.col("ancla_texto").isNotNull()),
        "anchor_too_long": F.size(F.split(F.trim("ancla_texto"), r"\s+")) > ANCHOR_WORDS,
        "anchor_span": (span <= 0) | (span != F.length("ancla_texto")),
        "tools_repeated": F.size(F.array_distinct("herramienta_esperada")) < F.size("herramienta_esperada"),
    }
    return F.array_compact(F.array(*(F.when(rule, code) for code, rule in rules.items())))


def holdout_class(known: Column) -> Column:
    """golden, sin_respuesta (an answer is not to be had) or no_evaluable."""
    no_number = (F.col("familia") != "extractiva") & F.col("cifra_esperada").isNull()
    return F.when(~F.col("familia").isin(*FAMILIES) | ~known, "no_evaluable").when(no_number & F.col("unidad").isNull(), "sin_respuesta").when(no_number, "no_evaluable").otherwise("golden")


def collection_problems(cases: DataFrame, expected: int | None = None, least_comparative: int = 0) -> DataFrame:
    """(id, problem): ids that come more than once; without an id, another number of cases than expected, too few comparatives."""
    again = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id_repeated").alias("problem"))
    totals = cases.agg(F.count("*").alias("n"), F.count_if(F.col("familia") == "comparativa").alias("comparative"))
    wrong = F.lit(False) if expected is None else F.col("n") != expected
    codes = F.array_compact(F.array(F.when(wrong, F.format_string("count %d of %d", F.col("n"), F.lit(expected or 0))), F.when(F.col("comparative") < least_comparative, F.format_string("comparatives %d of %d", F.col("comparative"), F.lit(least_comparative)))))
    return again.unionAll(totals.select(F.lit(None).cast(dict(cases.dtypes)["id"]).alias("id"), F.explode(codes).alias("problem")))


#: What a comparative answer must have, in the order in which what is missing is told.
COMPARATIVE_FIELDS = ("ticker", "unidad", "ejercicio_inicial", "cifra_inicial", "ejercicio_final", "cifra_final")


def comparative_verdict() -> Column:
    """`missing ...`, `source` (not both of them), `years` (the final one isn't later), or `ok`."""
    gone = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in COMPARATIVE_FIELDS))), ", ")
    late = F.col("ejercicio_final") > F.col("ejercicio_inicial")
    return F.when(gone != "", F.concat(F.lit("missing "), gone)).when(F.col("fuente") != "ambas", "source").when(~late, "years").otherwise("ok")


def expects_absence() -> Column:
    """A numeric case whose right answer is that there is no number."""
    return (F.col("familia") == "numerica") & F.col("cifra_esperada").isNull() & F.col("unidad").isNull()


def corpus_problems(cases: DataFrame, sections: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, problem): what a case says that the corpus doesn't: each case's first document fault, or its fact's and its section's.

    document_missing: no section of its company and year, unless no number is expected, and then nothing else is asked;
    fact_missing, fact_present: of families with a number, none of its concept there, or one though none is expected; sections N:
    of families with an anchor, not exactly one section of its item; offsets_wrong: that section's slice isn't the anchor.
    """
    place = ["ticker", "fiscal_year"]
    there = sections.select(*place).distinct().withColumn("there", F.lit(True))
    fact = facts.select(*place, F.col("concept").alias("concept_xbrl")).distinct().withColumn("reported", F.lit(True))
    by_item = sections.groupBy(*place, F.col("item").alias("item_esperado")).agg(F.count("*").alias("n_sections"), F.min("texto").alias("texto"))
    c = cases.withColumn("absent", expects_absence()).join(there, place, "left").join(fact, [*place, "concept_xbrl"], "left").join(by_item, [*place, "item_esperado"], "left")
    number, anchored, reported, n = F.col("familia").isin("numerica", "comparativa"), F.col("familia").isin("extractiva", "comparativa"), F.col("reported").isNotNull(), F.coalesce("n_sections", F.lit(0))
    slice_ = F.col("texto").substr((F.col("ancla_inicio") + 1).cast("int"), (F.col("ancla_fin") - F.col("ancla_inicio")).cast("int"))
    gone = F.col("there").isNull()
    codes = F.array_compact(F.array(
        F.when(gone & ~F.col("absent"), "document_missing"), F.when(~gone & number & ~reported & ~F.col("absent"), "fact_missing"), F.when(~gone & number & reported & F.col("absent"), "fact_present"),
        F.when(~gone & anchored & (n != 1), F.format_string("sections %d", n)), F.when(~gone & anchored & (n == 1) & ~slice_.eqNullSafe(F.col("ancla_texto")), "offsets_wrong")))
    return c.select("id", F.explode(codes).alias("problem"))


#: Faults that an error of load_cases() names.
TOLD = 20


def load_cases(spark: SparkSession, path: str, sections: DataFrame, facts: DataFrame, expected: int | None = None, least_comparative: int = 0) -> DataFrame:
    """The cases of a JSON-lines file, if all of it is right; else ValueError with its faults, and nothing is loaded.

    Each line is a case by the schema and by problems(), agrees with the corpus, and the collection keeps its rules. Texts are
    trimmed, tickers in upper case, blank optional texts null.
    """
    c = jsonl.read_strict(spark, path, schemas.CASE)
    c = c.select(*(F.upper(F.trim(f)).alias(f) if f == "ticker" else F.nullif(F.trim(f), F.lit("")).alias(f) if k == "string" and f != "ancla_texto" else F.col(f) for f, k in c.dtypes))
    text = lambda df: df.select(F.col("id").cast("string").alias("id"), F.col("problem").cast("string").alias("problem"))
    blank = c.select("id", F.explode(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f"blank:{f}")) for f in schemas.CASE_REQUIRED if f != "id")))).alias("problem"))
    found = text(c.select("id", F.explode(problems()).alias("problem"))).unionAll(text(blank)).unionAll(text(corpus_problems(c, sections, facts))).unionAll(text(collection_problems(c, expected, least_comparative)))
    told = [f"{r.id or path}: {r.problem}" for r in found.orderBy("id", "problem").limit(TOLD).collect()]
    if told:
        raise ValueError("; ".join(told))
    return c


def number_scored(answered: DataFrame, relative: float = 0.01, absolute: float = 0.0) -> DataFrame:
    """answered with `cifra_correcta`, null for cases of the extractive family.

    answered: a case's familia, cifra_esperada and unidad, and its answer's error, fuente, cifra and unidad_dicha. Where no number is
    expected it is right to have no error, the source `ninguna`, no number and no unit. Else number and unit must both be
    there, the units equal without regard to case and outer spaces, and the numbers within the symmetric tolerance; a number that isn't finite is wrong.
    """
    silent = F.col("error").isNull() & (F.col("fuente") == "ninguna") & F.col("cifra").isNull() & F.col("unidad_dicha").isNull()
    unit = lambda c: F.replace(F.lower(F.trim(c)), F.lit("ß"), F.lit("ss"))
    right = F.coalesce(N.close(F.col("cifra"), F.col("cifra_esperada"), relative, absolute) & (unit(F.col("unidad_dicha")) == unit(F.col("unidad"))), F.lit(False))
    return answered.withColumn("cifra_correcta", F.when(F.col("familia") != "extractiva", F.when(expects_absence(), F.coalesce(silent, F.lit(False))).otherwise(right)))
