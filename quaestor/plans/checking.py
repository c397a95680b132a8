"""The number checker over answers that reach each of its verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestor.operators import numbers
from quaestor.sources.tables import stored

from . import views as V
from .registry import query

TOLERANCE = 0.01
#: Facts with a value that isn't whole and small, so that rounding it shows.
_MORE = f"""{V.FACTS}, all_facts AS (SELECT ticker, fiscal_year, concept, value, unit FROM facts UNION ALL
 SELECT q.ticker, q.fiscal_year, 'QuantityPerLine', round(q.value / n.value, 2), 'pieces/row' FROM facts q JOIN facts n ON n.ticker = q.ticker AND n.fiscal_year = q.fiscal_year AND n.concept = 'Lines' WHERE q.concept = 'Quantity')"""


def all_facts(spark, sf_dir):
    f = stored(V.facts(spark, sf_dir).select(*numbers.FACT), "reported")
    per = f.where("concept = 'Quantity'").join(f.where("concept = 'Lines'").select("ticker", "fiscal_year", F.col("value").alias("n")), ["ticker", "fiscal_year"])
    return stored(f.unionAll(per.select("ticker", "fiscal_year", F.lit("QuantityPerLine"), F.round(F.col("value") / F.col("n"), 2), F.lit("pieces/row"))), "facts")  # read many times


# What a question's calls asked for: a purchase or a click asks for the fact of the year, concept and segment that its number names.
_CONSULTED = f"""{_MORE}, {V.TRACE}, tickers AS (SELECT list(ticker ORDER BY ticker) AS names FROM (SELECT DISTINCT ticker FROM facts)),
asked AS (SELECT DISTINCT question_id, names[(question_id % 5 + 1)::INT] AS ticker, 1992 + k % 7 AS fiscal_year, (['Revenue', 'Quantity', 'QuantityPerLine'])[(k % 3 + 1)::INT] AS concept FROM trace, tickers WHERE tool IN ('purchase', 'click')),
consulted AS (SELECT question_id, f.* FROM asked a JOIN all_facts f ON f.ticker = a.ticker AND f.fiscal_year = a.fiscal_year AND f.concept = a.concept)"""


def consulted(spark, sf_dir, f):
    """(question_id, FACT): the facts, of `f`, that each question's calls asked for."""
    names = f.agg(F.sort_array(F.collect_set("ticker")).alias("names"))  # five segments
    t = V.trace(spark, sf_dir).where("tool IN ('purchase', 'click')").crossJoin(F.broadcast(names))
    concept = F.element_at(F.array(*map(F.lit, ("Revenue", "Quantity", "QuantityPerLine"))), (F.col("k") % 3 + 1).cast("int"))
    asked = t.select("question_id", F.element_at("names", (F.col("question_id") % 5 + 1).cast("int")).alias("ticker"), (F.col("k") % 7 + 1992).alias("fiscal_year"), concept.alias("concept")).distinct()
    return asked.join(f, ["ticker", "fiscal_year", "concept"]).select("question_id", *numbers.FACT)


_DERIVED = """pairs AS (SELECT a.question_id, a.ticker, a.fiscal_year AS ay, a.concept AS ac, a.value AS av, b.fiscal_year AS by_, b.concept AS bc, b.value AS bv FROM consulted a JOIN consulted b ON b.question_id = a.question_id AND b.ticker = a.ticker WHERE a.fiscal_year <> b.fiscal_year OR a.concept <> b.concept),
derived AS (SELECT question_id, ticker, 'difference' AS kind, av - bv AS derived FROM pairs WHERE ac = bc UNION ALL SELECT question_id, ticker, 'change', (av - bv) / bv * 100 FROM pairs WHERE ac = bc AND bv <> 0
 UNION ALL SELECT question_id, ticker, 'ratio', av / bv * 100 FROM pairs WHERE ac <> bc AND ay = by_ AND bv <> 0)"""

# An answer for each question: what it claims goes by its number, so that each verdict is reached.
_ANSWERS = f"""{_CONSULTED}, {_DERIVED}, firsts AS (SELECT question_id, min(struct_pack(ticker := ticker, fiscal_year := fiscal_year, concept := concept, value := value, unit := unit)) AS f,
 min(struct_pack(fiscal_year := fiscal_year, value := value)) FILTER (concept = 'QuantityPerLine') AS small FROM consulted GROUP BY 1),
best AS (SELECT question_id, max(derived) FILTER (kind = 'difference') AS difference, max(derived) FILTER (kind = 'change') AS change, max(derived) FILTER (kind = 'ratio') AS ratio FROM derived GROUP BY 1),
questions AS (SELECT DISTINCT question_id FROM trace),
answers AS (SELECT q.question_id, CASE q.question_id % 13 WHEN 3 THEN best.difference WHEN 4 THEN best.change WHEN 5 THEN best.ratio WHEN 6 THEN l.value WHEN 7 THEN f.value * 3.7::DOUBLE WHEN 8 THEN f.value * 3.7::DOUBLE WHEN 9 THEN round_even(small.value, 0)
  WHEN 10 THEN NULL WHEN 11 THEN f.value * 5.1::DOUBLE WHEN 12 THEN f.value * 1.004::DOUBLE ELSE coalesce(f.value, 123::DOUBLE) END AS claimed,
 CASE q.question_id % 13 WHEN 8 THEN 'NOWHERE' WHEN 12 THEN '  ' ELSE ' ' || lower(f.ticker) END AS ticker, CASE q.question_id % 13 WHEN 2 THEN f.fiscal_year + 1 WHEN 9 THEN small.fiscal_year WHEN 12 THEN NULL ELSE f.fiscal_year END AS fiscal_year,
 CASE q.question_id % 13 WHEN 1 THEN 'dólares' WHEN 12 THEN NULL ELSE lower(f.unit) END AS unit, q.question_id % 13 = 11 AS corrected
 FROM questions q LEFT JOIN firsts ON firsts.question_id = q.question_id LEFT JOIN best ON best.question_id = q.question_id LEFT JOIN all_facts l ON l.ticker = f.ticker AND l.fiscal_year = f.fiscal_year AND l.concept = 'Lines')"""


def answers(spark, sf_dir, f, c):
    """An answer for each question, by the facts `f` and those that it consulted, `c`."""
    firsts = c.groupBy("question_id").agg(F.min(F.struct(*numbers.FACT)).alias("f"), F.min(F.when(F.col("concept") == "QuantityPerLine", F.struct("fiscal_year", "value"))).alias("small"))
    kinds = ("difference", "change", "ratio")
    best = numbers.derived(c, ["question_id"]).groupBy("question_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("derived"))).alias(k) for k in kinds))
    lines = f.where("concept = 'Lines'").select(F.struct("ticker", "fiscal_year").alias("place"), F.col("value").alias("lines"))
    q = V.trace(spark, sf_dir).select("question_id").distinct().join(firsts, "question_id", "left").join(best, "question_id", "left")
    q = q.join(F.broadcast(lines), F.struct("f.ticker", "f.fiscal_year") == F.col("place"), "left")  # a row for each company and year of the five segments
    n, value = F.col("question_id") % 13, F.col("f.value")
    pick = lambda base, **by: _cases(n, base, {int(k[1:]): v for k, v in by.items()})
    claimed = pick(F.coalesce(value, F.lit(123.0)), _3=F.col("difference"), _4=F.col("change"), _5=F.col("ratio"), _6=F.col("lines"), _7=value * 3.7, _8=value * 3.7, _9=F.bround("small.value"), _10=F.lit(None).cast("double"), _11=value * 5.1, _12=value * 1.004)
    ticker = pick(F.concat(F.lit(" "), F.lower("f.ticker")), _8=F.lit("NOWHERE"), _12=F.lit("  "))
    year = pick(F.col("f.fiscal_year"), _2=F.col("f.fiscal_year") + 1, _9=F.col("small.fiscal_year"), _12=F.lit(None).cast("long"))
    unit = pick(F.lower("f.unit"), _1=F.lit("dólares"), _12=F.lit(None).cast("string"))
    return q.select("question_id", claimed.alias("claimed"), ticker.alias("ticker"), year.alias("fiscal_year"), unit.alias("unit"), (n == 11).alias("corrected"))


def _cases(n, base, by):
    out = None
    for k, v in by.items():
        out = F.when(n == k, v) if out is None else out.when(n == k, v)
    return out.otherwise(base)


_NEAR = "CASE WHEN {v} = 0 THEN {c} = 0 ELSE abs({c} - {v}) / abs({v}) <= 0.01::DOUBLE END"
_CHECK = f"""WITH {_ANSWERS}, said AS (SELECT question_id, claimed, nullif(upper(trim(ticker)), '') AS ticker, fiscal_year, unit, corrected FROM answers),
names AS (SELECT *, concat_ws('/', ticker, fiscal_year, concept) AS name FROM all_facts), known AS (SELECT *, concat_ws('/', ticker, fiscal_year, concept) AS name FROM consulted),
near AS (SELECT a.question_id, (a.ticker IS NULL OR a.ticker = k.ticker) AND (a.fiscal_year IS NULL OR a.fiscal_year = k.fiscal_year) AS mine, k.* EXCLUDE (question_id) FROM said a JOIN known k ON k.question_id = a.question_id AND {_NEAR.format(c='a.claimed', v='k.value')}),
v AS (SELECT a.*, (SELECT arg_min(name, [ticker, fiscal_year::VARCHAR, concept]) FROM near n WHERE n.question_id = a.question_id AND mine) AS matched, (SELECT min(unit) FROM near n WHERE n.question_id = a.question_id AND mine) AS u1, (SELECT max(unit) FROM near n WHERE n.question_id = a.question_id AND mine) AS u2,
 (SELECT arg_min(name, [ticker, fiscal_year::VARCHAR, concept]) FROM near n WHERE n.question_id = a.question_id AND NOT mine) AS other, EXISTS (SELECT 1 FROM derived d WHERE d.question_id = a.question_id AND {_NEAR.format(c='a.claimed', v='d.derived')}) AS made,
 (SELECT arg_min(name, [ticker, fiscal_year::VARCHAR, concept]) FROM known k WHERE k.question_id = a.question_id AND k.value <> floor(k.value) AND round_even(k.value, 0) = a.claimed AND (a.ticker IS NULL OR a.ticker = k.ticker) AND (a.fiscal_year IS NULL OR a.fiscal_year = k.fiscal_year)) AS rounded,
 EXISTS (SELECT 1 FROM all_facts f WHERE f.ticker = a.ticker AND f.fiscal_year = a.fiscal_year) AS there,
 (SELECT arg_min(name, [ticker, fiscal_year::VARCHAR, concept]) FROM names f WHERE f.ticker = a.ticker AND f.fiscal_year = a.fiscal_year AND {_NEAR.format(c='a.claimed', v='f.value')} AND NOT EXISTS (SELECT 1 FROM known k WHERE k.question_id = a.question_id AND k.name = f.name)) AS unread FROM said a),
w AS (SELECT *, CASE WHEN claimed IS NULL THEN 'no_number' WHEN matched IS NOT NULL AND u1 = u2 AND lower(trim(coalesce(unit, ''))) <> lower(u1) THEN 'unit_normalised' WHEN matched IS NOT NULL THEN 'match' WHEN made THEN 'derived' WHEN corrected THEN 'kept' WHEN rounded IS NOT NULL THEN 'rounded'
 WHEN other IS NOT NULL THEN 'other_identity' WHEN ticker IS NOT NULL AND fiscal_year IS NOT NULL AND NOT there THEN 'no_facts' WHEN unread IS NOT NULL THEN 'unconsulted' ELSE 'no_match' END AS verdict FROM v)"""


@query(_CHECK + " SELECT question_id, verdict, CASE verdict WHEN 'match' THEN matched WHEN 'unit_normalised' THEN matched WHEN 'rounded' THEN rounded WHEN 'other_identity' THEN other WHEN 'unconsulted' THEN unread END AS fact, CASE verdict WHEN 'unit_normalised' THEN u1 ELSE unit END AS unit FROM w")
def number_checker(spark, sf_dir):
    """Each answer's number against consulted facts, values derived from them, and all facts."""
    f = all_facts(spark, sf_dir)
    c = stored(consulted(spark, sf_dir, f), "consulted")  # the checker reads each of the three tables several times
    return numbers.check(stored(answers(spark, sf_dir, f, c), "answers"), c, f, TOLERANCE)


@query(_CHECK + " SELECT verdict, count(*) AS n FROM w GROUP BY 1")
def number_checker_summary(spark, sf_dir):
    """How many answers have each verdict."""
    return number_checker(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {V.CLAIMS}, p AS (SELECT a.ticker, a.fiscal_year AS ay, a.concept AS ac, a.value AS av, b.fiscal_year AS by_, b.concept AS bc, b.value AS bv FROM facts a JOIN facts b ON b.ticker = a.ticker AND (a.fiscal_year <> b.fiscal_year OR a.concept <> b.concept)),
d AS (SELECT ticker, 'difference' AS kind, ay || '/' || ac AS first, by_ || '/' || bc AS second, av - bv AS derived FROM p WHERE ac = bc UNION ALL SELECT ticker, 'change', ay || '/' || ac, by_ || '/' || bc, (av - bv) / bv * 100 FROM p WHERE ac = bc AND bv <> 0
 UNION ALL SELECT ticker, 'ratio', ay || '/' || ac, by_ || '/' || bc, av / bv * 100 FROM p WHERE ay = by_ AND ac <> bc AND bv <> 0)
SELECT claim_id, d.kind AS kind, first, second FROM claims c JOIN d ON d.ticker = c.ticker AND {_NEAR.format(c='c.claimed', v='d.derived')}""")
def claim_derived(spark, sf_dir):
    """Differences, changes and ratios of two facts of its company that a claim is near, by bands of magnitude."""
    d = numbers.derived(V.facts(spark, sf_dir), [])
    return numbers.band_join(V.claims(spark, sf_dir).select("claim_id", "ticker", "claimed"), d, ["ticker"], "claimed", "derived", TOLERANCE).select("claim_id", "kind", "first", "second")
