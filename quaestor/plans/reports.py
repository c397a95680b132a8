"""Catalogues, facts, corpus figures, and reports over scored answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T

from quaestor.operators import quantiles

from . import views as V
from .registry import query

S = f"WITH {V.SECTIONS}"
X = f"WITH {V.FACTS}"
R = f"WITH {V.RESULTS}"


def _long(c):
    return F.col(c).cast("long").alias(c)


@query(S + """, y AS (SELECT ticker, fiscal_year, 'FY' || fiscal_year || ': ' || string_agg(DISTINCT item, ', ' ORDER BY item) AS part FROM sections GROUP BY ticker, fiscal_year)
SELECT ticker, '- ' || ticker || ' — ' || string_agg(part, '; ' ORDER BY fiscal_year) AS line FROM y GROUP BY 1""")
def catalog_lines(spark, sf_dir):
    """A line for each company, its years and their items."""
    s = V.sections(spark, sf_dir).groupBy("ticker", "fiscal_year").agg(F.array_join(F.sort_array(F.collect_set("item")), ", ").alias("items"))
    s = s.select("ticker", F.struct("fiscal_year", F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"), F.lit(": "), "items").alias("part")).alias("y"))
    return s.groupBy("ticker").agg(F.concat(F.lit("- "), F.col("ticker"), F.lit(" — "), F.array_join(F.sort_array(F.collect_list("y"))["part"], "; ")).alias("line"))


@query(S + " SELECT ticker, string_agg(DISTINCT fiscal_year::VARCHAR, ',' ORDER BY fiscal_year::VARCHAR) AS years, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM sections GROUP BY 1")
def catalog_flat(spark, sf_dir):
    """D02."""
    s = V.sections(spark, sf_dir)
    return s.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_set(F.col("fiscal_year").cast("string"))), ",").alias("years"), F.array_join(F.sort_array(F.collect_set("item")), ",").alias("items"))


@query("SELECT source, count(DISTINCT lang) AS n_names FROM documents GROUP BY 1 HAVING count(DISTINCT lang) <> 1")
def identity_violations(spark, sf_dir):
    """Identities that have more than one name."""
    return V.table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_names")).where("n_names <> 1")


@query(X + """, w AS (SELECT DISTINCT ticker, fiscal_year, c AS concept FROM facts, (VALUES ('Revenue'), ('Margin')) v(c)), known AS (SELECT ticker, fiscal_year, string_agg(DISTINCT concept, ', ' ORDER BY concept) AS available FROM facts GROUP BY ALL)
SELECT w.ticker, w.fiscal_year, w.concept, f.value, CASE WHEN f.value IS NULL THEN known.available END AS available FROM w LEFT JOIN facts f ON f.ticker = w.ticker AND f.fiscal_year = w.fiscal_year AND f.concept = w.concept LEFT JOIN known ON known.ticker = w.ticker AND known.fiscal_year = w.fiscal_year""")
def fact_lookup(spark, sf_dir):
    """A fact by its three keys (the first by value and unit), or the concepts there are."""
    f = V.facts(spark, sf_dir)
    wanted = f.select("ticker", "fiscal_year").distinct().withColumn("concept", F.explode(F.array(F.lit("Revenue"), F.lit("Margin"))))
    one = f.groupBy("ticker", "fiscal_year", "concept").agg(F.min(F.struct("value", "unit"))["value"].alias("value"))
    known = f.groupBy("ticker", "fiscal_year").agg(F.array_join(F.sort_array(F.collect_set("concept")), ", ").alias("known"))
    j = wanted.join(one, ["ticker", "fiscal_year", "concept"], "left").join(known, ["ticker", "fiscal_year"], "left")
    return j.select("ticker", "fiscal_year", "concept", "value", F.when(F.col("value").isNull(), F.col("known")).alias("available"))


@query(X + " SELECT ticker, fiscal_year, concept, concept || ' = ' || format('{:,}', round_even(value, 0)::BIGINT) || ' ' || unit AS rendered FROM facts")
def fact_render(spark, sf_dir):
    """Whole numbers with separators, halves to even."""
    return V.facts(spark, sf_dir).select("ticker", "fiscal_year", "concept", F.concat("concept", F.lit(" = "), F.format_number("value", 0), F.lit(" "), "unit").alias("rendered"))


@query(S + """, w AS (SELECT DISTINCT ticker, i AS item FROM sections, (VALUES ('1A'), ('9B')) v(i)), o AS (SELECT ticker, item, min(doc_id) AS doc_id FROM sections WHERE fiscal_year = 2024 GROUP BY ALL)
SELECT w.ticker, w.item, o.doc_id, coalesce(length(s.texto), 0) AS n_chars, coalesce(s.texto, 'Section not available') AS texto FROM w LEFT JOIN o ON o.ticker = w.ticker AND o.item = w.item LEFT JOIN sections s ON s.doc_id = o.doc_id""")
def section_lookup(spark, sf_dir):
    """A section's text, or that there is none."""
    s = V.sections(spark, sf_dir)
    wanted = s.select("ticker").distinct().withColumn("item", F.explode(F.array(F.lit("1A"), F.lit("9B"))))
    one = s.where("fiscal_year = 2024").groupBy("ticker", "item").agg(F.min(F.struct("doc_id", "texto")).alias("s"))
    return wanted.join(one, ["ticker", "item"], "left").select("ticker", "item", F.col("s.doc_id").alias("doc_id"), F.coalesce(F.length("s.texto"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce("s.texto", F.lit("Section not available")).alias("texto"))


@query(X + " SELECT ticker, fiscal_year, concept, value FROM facts WHERE fiscal_year IN (1995, 1997)")
def year_in_list(spark, sf_dir):
    """B06."""
    return V.facts(spark, sf_dir).where(F.col("fiscal_year").isin(1995, 1997)).select("ticker", "fiscal_year", "concept", "value")


@query(X + ", g AS (SELECT ticker, fiscal_year, count(*) AS n, string_agg(concept || '=' || round(value, 2)::BIGINT, ',' ORDER BY concept) AS facts FROM facts GROUP BY ALL) SELECT g.*, (SELECT count(DISTINCT ticker) FROM facts) AS n_companies FROM g")
def facts_by_entity(spark, sf_dir):
    """The facts of each company and year, and how many companies there are."""
    f = V.facts(spark, sf_dir)
    g = f.groupBy("ticker", "fiscal_year").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("concept", F.concat("concept", F.lit("="), F.round(F.round("value", 2)).cast("long").cast("string")).alias("t")))).alias("l"))
    # one row of companies beside all rows
    return g.crossJoin(f.agg(F.count_distinct("ticker").alias("n_companies"))).select("ticker", "fiscal_year", "n", F.array_join(F.col("l.t"), ",").alias("facts"), "n_companies")


@query(S + " SELECT ticker, fiscal_year, item, count(*) AS n FROM sections GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Section keys that aren't unique."""
    return V.sections(spark, sf_dir).groupBy("ticker", "fiscal_year", "item").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT 'documents' AS name, 'missing_column' AS problem, 'item' AS col UNION ALL SELECT 'documents', 'nulls', c FROM (SELECT 'text' AS c, count(*) FILTER (text IS NULL) AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents) WHERE n > 0 UNION ALL SELECT 'labels', 'nulls', 'quality' FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id HAVING count(*) FILTER (quality IS NULL) > 0")
def required_nulls(spark, sf_dir):
    """Required columns that are missing or hold nulls."""
    d = V.table(spark, sf_dir, "documents")
    j = d.join(V.table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = [("documents", "missing_column", c) for c in ("text", "item") if c not in d.columns]
    checks = {("documents", "text"): "text", ("documents", "lang"): "lang", ("labels", "quality"): "quality"}
    nulls = j.agg(*(F.max(F.col(c).isNull()).alias(c) for c in checks.values()))
    pairs = F.array(*(F.struct(F.lit(t).alias("name"), F.lit("nulls").alias("problem"), F.lit(c).alias("col"), F.col(c).alias("bad")) for t, c in checks))
    found = nulls.select(F.explode(pairs).alias("p")).where("p.bad").select("p.name", "p.problem", "p.col")
    return spark.createDataFrame(missing, "name string, problem string, col string").unionAll(found)


@query(S + " SELECT doc_id, n_tokens, n_tokens > 2000 AS expensive FROM sections WHERE n_tokens > 500")
def expensive_sections(spark, sf_dir):
    """What a threshold on tokens would hold back."""
    return V.sections(spark, sf_dir).where("n_tokens > 500").select("doc_id", "n_tokens", (F.col("n_tokens") > 2000).alias("expensive"))


@query(f"WITH {V.CHUNKS} SELECT item, count(*) AS n, count(*) FILTER (contiene_tabla) AS tables, round(avg(n_tokens), 4) AS mean_tokens, round(100.0::DOUBLE * count(*) FILTER (contiene_tabla) / count(*), 2) AS percent FROM chunks GROUP BY 1")
def chunk_stats(spark, sf_dir):
    """D11."""
    c = V.chunks(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"), F.count_if("contiene_tabla").alias("tables"), F.round(F.avg("n_tokens"), 4).alias("mean_tokens"))
    return c.withColumn("percent", F.round(F.lit(100.0) * F.col("tables") / F.col("n"), 2))


@query(S + """, p AS (SELECT ticker, fiscal_year, round(avg(n_tokens) FILTER (item = '1A'), 4) AS i1A, round(avg(n_tokens) FILTER (item = '7'), 4) AS i7, round(avg(n_tokens) FILTER (item = '7A'), 4) AS i7A, round(avg(n_tokens) FILTER (item = '8'), 4) AS i8 FROM sections GROUP BY ALL)
SELECT *, round(coalesce(i1A, 0) + coalesce(i7, 0) + coalesce(i7A, 0) + coalesce(i8, 0), 3) AS total FROM p""")
def token_pivot(spark, sf_dir):
    """Mean tokens by item, and a total."""
    p = V.sections(spark, sf_dir).withColumn("item", F.concat(F.lit("i"), "item")).groupBy("ticker", "fiscal_year").pivot("item", ["i1A", "i7", "i7A", "i8"]).agg(F.round(F.avg("n_tokens"), 4))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("i7", "i7A", "i8")), F.coalesce(F.col("i1A"), F.lit(0.0)))
    return p.withColumn("total", F.round(total, 3))


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'word:' || w, count(*) FROM (SELECT unnest(string_split(role || ' ' || (turn % 3), ' ')) AS w FROM conversations) GROUP BY 1")
def tool_counts(spark, sf_dir):
    """Counts of values, and of exploded ones."""
    tools = V.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))
    words = V.table(spark, sf_dir, "conversations").select(F.explode(F.split(F.concat_ws(" ", "role", F.col("turn") % 3), " ")).alias("w"))
    return tools.unionAll(words.groupBy(F.concat(F.lit("word:"), "w")).agg(F.count("*")))


@query("SELECT event_type AS tool, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY 1")
def latency_profile(spark, sf_dir):
    """Median, linear 95th percentile, count."""
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), "value")
    p = quantiles.exact_percentiles(e, ["tool"], "value", [0.5, 0.95])
    at = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("percentile"))), 6)
    return e.groupBy("tool").agg(F.count("value").alias("n")).join(p.groupBy("tool").agg(at(0.5).alias("median"), at(0.95).alias("p95")), "tool", "left")


@query(R + " SELECT ticker, count(*) AS n, CASE WHEN count(coste) = count(*) THEN round(sum(coste), 9) END AS strict_total, round(sum(coste), 9) AS total FROM results GROUP BY 1")
def cost_strict_sum(spark, sf_dir):
    """A total that is null if any part is."""
    return V.results(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), F.round(N.strict_sum(F.col("coste")), 9).alias("strict_total"), F.round(F.sum("coste"), 9).alias("total"))


@query("SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) END)::BIGINT AS tokens_in, sum(CASE WHEN role = 'assistant' THEN length(text) END)::BIGINT AS tokens_out FROM conversations GROUP BY 1")
def token_usage_sums(spark, sf_dir):
    """Null only where no message reported."""
    c = V.table(spark, sf_dir, "conversations")
    part = lambda role: F.sum(F.when(F.col("role") == role, F.length("text"))).cast("long")
    return c.groupBy("conv_id").agg(part("user").alias("tokens_in"), part("assistant").alias("tokens_out"))


_PRICES = [("en", 0.15, 0.6), ("fr", 0.4, 1.6), ("de", 2.5, 10.0)]
_PRICES_SQL = ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in _PRICES)


@query(f"WITH p(model, price_in, price_out) AS (VALUES {_PRICES_SQL}) SELECT doc_id, lang AS model, round((n_chars * price_in + (n_chars % 300) * price_out) / 1e6::DOUBLE, 9) AS cost FROM documents LEFT JOIN p ON p.model = lang")
def model_cost(spark, sf_dir):
    """A model without a price has no cost."""
    prices = F.broadcast(spark.createDataFrame(_PRICES, "model string, price_in double, price_out double"))  # three rows
    d = V.table(spark, sf_dir, "documents").withColumnRenamed("lang", "model").join(prices, "model", "left")
    return d.select("doc_id", "model", F.round(N.token_cost(F.col("n_chars"), F.col("n_chars") % 300, F.col("price_in"), F.col("price_out")), 9).alias("cost"))


@query(S + """, q AS (SELECT item, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n FROM sections GROUP BY 1) SELECT item, g.students::BIGINT AS students, round(tokens / n * 20 * students * 0.15::DOUBLE / 1e6::DOUBLE, 6) AS cost FROM q, (VALUES (1), (5), (25)) g(students)""")
def cost_scenario(spark, sf_dir):
    """The cost of a path by questions and groups."""
    q = V.sections(spark, sf_dir).groupBy("item").agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("n"))
    q = q.withColumn("students", F.explode(F.array(*(F.lit(x).cast("long") for x in (1, 5, 25)))))
    return q.select("item", "students", F.round(F.col("tokens") / F.col("n") * 20 * F.col("students") * 0.15 / 1e6, 6).alias("cost"))


@query(S + " SELECT count(*) AS n, sum(n_tokens)::BIGINT AS tokens, max(n_tokens) AS largest, min(n_tokens) AS smallest, round(avg(n_tokens), 6) AS mean, count(DISTINCT ticker) AS tickers, count(DISTINCT item) AS items FROM sections")
def corpus_totals(spark, sf_dir):
    """D18, D24."""
    s = V.sections(spark, sf_dir)
    return s.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"), F.min("n_tokens").alias("smallest"), F.round(F.avg("n_tokens"), 6).alias("mean"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("item").alias("items"))


@query(S + " SELECT doc_id, n_tokens FROM sections ORDER BY n_tokens DESC, doc_id LIMIT 1")
def largest_section(spark, sf_dir):
    """F03."""
    return V.sections(spark, sf_dir).select("doc_id", "n_tokens").orderBy(F.desc("n_tokens"), "doc_id").limit(1)


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9$%.]+')) AS term FROM documents) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY 1""")
def token_stats(spark, sf_dir):
    """Each token's count and document frequency; partial sums by document first."""
    t = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


@query("SELECT 'quality' AS tag, quality AS value, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY ALL")
def tagged_union(spark, sf_dir):
    """Data sets one under another, with their names."""
    lab = V.table(spark, sf_dir, "labels")
    return lab.select(F.lit("quality").alias("tag"), F.col("quality").alias("value")).unionByName(lab.select(F.lit("toxic").alias("tag"), F.col("toxic").alias("value"))).groupBy("tag", "value").agg(F.count("*").alias("n"))


# Reports over scored answers. acierto: trajectory and every criterion that applies; null criteria don't count.
_HIT = "(trayectoria AND coalesce(cita, true) AND coalesce(cifra, true))"


def _with_hit(r):
    return r.withColumn("acierto", F.expr(_HIT))


@query(R + f""" SELECT coalesce(familia, 'all') AS familia, count(*) AS n, count(*) FILTER ({_HIT}) AS hits, round(count(*) FILTER ({_HIT})::DOUBLE / count(*), 6) AS rate, round(avg(recall), 6) AS recall, round(count(recall)::DOUBLE / count(*), 6) AS recall_coverage,
round(avg(coste), 9) AS cost, round(count(coste)::DOUBLE / count(*), 6) AS cost_coverage, round(avg(latencia_ms), 6) AS latency_ms, round(avg(llamadas), 6) AS calls FROM results GROUP BY GROUPING SETS ((), (familia))""")
def report_metrics(spark, sf_dir):
    """Rates, means and how much they cover, by family and for all."""
    r = _with_hit(V.results(spark, sf_dir)).rollup("familia")
    n = F.count("*")
    return r.agg(
        n.alias("n"), F.count_if("acierto").alias("hits"), F.round(F.count_if("acierto") / n, 6).alias("rate"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.count("recall") / n, 6).alias("recall_coverage"),
        F.round(F.avg("coste"), 9).alias("cost"), F.round(F.count("coste") / n, 6).alias("cost_coverage"), F.round(F.avg("latencia_ms"), 6).alias("latency_ms"), F.round(F.avg("llamadas"), 6).alias("calls")).withColumn("familia", F.coalesce("familia", F.lit("all")))


@query(R + f""" SELECT round(avg(cita::INT), 6) AS cita, round(avg(cifra::INT), 6) AS cifra, round(avg(trayectoria::INT), 6) AS trayectoria, round(avg(recall), 6) AS recall, round(avg(coalesce(coste, 0)) * 100, 6) AS cents, round(avg(latencia_ms) / 1000, 6) AS seconds, round(avg(llamadas), 6) AS calls,
count(*) FILTER (familia = 'extractiva' AND {_HIT}) || '/' || count(*) FILTER (familia = 'extractiva') AS extractiva, count(*) FILTER (familia = 'numerica' AND {_HIT}) || '/' || count(*) FILTER (familia = 'numerica') AS numerica, count(*) FILTER (familia = 'comparativa' AND {_HIT}) || '/' || count(*) FILTER (familia = 'comparativa') AS comparativa FROM results""")
def summary_row(spark, sf_dir):
    """One row for a whole run; a null cost counts as zero here."""
    r = _with_hit(V.results(spark, sf_dir))
    mean = lambda c: F.avg(F.col(c).cast("int"))
    part = lambda f: F.concat(F.count_if((F.col("familia") == f) & F.col("acierto")).cast("string"), F.lit("/"), F.count_if(F.col("familia") == f).cast("string")).alias(f)
    return r.agg(
        F.round(mean("cita"), 6).alias("cita"), F.round(mean("cifra"), 6).alias("cifra"), F.round(mean("trayectoria"), 6).alias("trayectoria"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.coalesce("coste", F.lit(0.0))) * 100, 6).alias("cents"),
        F.round(F.avg("latencia_ms") / 1000, 6).alias("seconds"), F.round(F.avg("llamadas"), 6).alias("calls"), part("extractiva"), part("numerica"), part("comparativa"))


@query(R + " SELECT familia, sum(CASE WHEN trayectoria AND (familia = 'numerica' OR coalesce(cita, false)) AND (familia = 'extractiva' OR coalesce(cifra, false)) THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS n FROM results GROUP BY 1")
def family_hits_rebuilt(spark, sf_dir):
    """Hits from the criteria that each family has."""
    hit = F.col("trayectoria") & ((F.col("familia") == "numerica") | F.coalesce("cita", F.lit(False))) & ((F.col("familia") == "extractiva") | F.coalesce("cifra", F.lit(False)))
    return V.results(spark, sf_dir).groupBy("familia").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


@query(R + f" SELECT id, {_HIT} AS acierto FROM results")
def overall_hit(spark, sf_dir):
    """What applies holds; null doesn't count against."""
    return _with_hit(V.results(spark, sf_dir)).select("id", "acierto")


@query(R + """, g AS (SELECT item_id AS id, text FROM benchmark) SELECT r.id, r.familia, r.latencia_ms / 1000::DOUBLE AS latencia_s, coalesce(r.coste, 0) AS coste_usd, r.llamadas, CASE WHEN r.familia = 'numerica' THEN NULL ELSE r.cita END AS cita, g.id IS NOT NULL AS known_case FROM results r LEFT JOIN g ON g.id = r.id""")
def result_with_case(spark, sf_dir):
    """The row of a report, and whether its case is known."""
    g = V.questions(spark, sf_dir).select(F.col("query_id").alias("id"), F.lit(True).alias("known"))
    r = V.results(spark, sf_dir).join(g, "id", "left")
    return r.select("id", "familia", (F.col("latencia_ms") / F.lit(1000.0)).alias("latencia_s"), F.coalesce("coste", F.lit(0.0)).alias("coste_usd"), "llamadas", F.when(F.col("familia") != "numerica", F.col("cita")).alias("cita"), F.coalesce("known", F.lit(False)).alias("known_case"))


@query(R + """ SELECT id, array_to_string(list_filter([CASE WHEN NOT trayectoria THEN 'trajectory' END, CASE WHEN cita = false THEN 'citation' END, CASE WHEN cifra = false THEN 'number' END, CASE WHEN recall = 0 THEN 'recall' END], lambda x: x IS NOT NULL), '; ') AS observations FROM results""")
def observations(spark, sf_dir):
    """What went wrong, as a list."""
    r = V.results(spark, sf_dir)
    return r.select("id", F.array_join(F.array_compact(_faults()), "; ").alias("observations"))


def _faults():
    return F.array(F.when(~F.col("trayectoria"), "trajectory"), F.when(~F.col("cita"), "citation"), F.when(~F.col("cifra"), "number"), F.when(F.col("recall") == 0, "recall"))


@query(R + f""" SELECT id, printf('[%s] %s: %s (%d calls)', familia, ticker, CASE WHEN cifra = false THEN 'number' WHEN cita = false THEN 'citation' ELSE 'trajectory' END, llamadas) AS diagnosis FROM results WHERE NOT {_HIT}""")
def diagnosis(spark, sf_dir):
    """I16: a line for each miss."""
    r = _with_hit(V.results(spark, sf_dir)).where("NOT acierto")
    why = F.when(~F.col("cifra"), "number").when(~F.col("cita"), "citation").otherwise("trajectory")
    return r.select("id", F.format_string("[%s] %s: %s (%d calls)", "familia", "ticker", why, "llamadas").alias("diagnosis"))


@query(R + """ SELECT ticker, id FROM (SELECT ticker, id, row_number() OVER (PARTITION BY ticker ORDER BY coste DESC NULLS LAST, id) AS n FROM results) WHERE n <= 2""")
def costliest_by_company(spark, sf_dir):
    """the two most expensive answers of each company."""
    w = Window.partitionBy("ticker").orderBy(F.col("coste").desc_nulls_last(), "id")
    return V.results(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 2").select("ticker", "id")
