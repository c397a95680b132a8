"""Cases, scoring, traces, guards and chunks over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import numeric as N
from quaestor.functions import text as T
from quaestor.operators import chunking, golden, positions

from . import texts
from . import views as V
from .registry import query

# Cases: one for each document, of three families, with what each needs; some lack it or have too much.
CASES = """cases AS (SELECT doc_id AS id, (['extractiva','numerica','comparativa'])[doc_id % 3 + 1] AS familia, upper(source) AS ticker, 2024 + doc_id % 2 AS fiscal_year,
 CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'Revenue' END ELSE CASE WHEN doc_id % 13 <> 0 THEN 'Revenue' END END AS concept_xbrl,
 CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN n_chars::DOUBLE END AS cifra_esperada, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 <> 0 THEN 'USD' END AS unidad,
 CASE WHEN doc_id % 3 <> 1 OR doc_id % 17 = 0 THEN (['1A','7','7A','8'])[doc_id % 4 + 1] END AS item_esperado,
 CASE WHEN doc_id % 3 <> 1 THEN substring(text, 6, CASE WHEN doc_id % 19 = 0 THEN 400 ELSE 30 END) END AS ancla_texto, CASE WHEN doc_id % 3 <> 1 THEN 5::BIGINT END AS ancla_inicio,
 CASE WHEN doc_id % 3 <> 1 THEN 5 + length(substring(text, 6, CASE WHEN doc_id % 19 = 0 THEN 400 ELSE 30 END)) + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END END AS ancla_fin,
 CASE WHEN doc_id % 29 = 0 THEN ['catalogo', 'catalogo'] ELSE ['buscar', 'leer'] END AS herramienta_esperada FROM documents)"""


def cases(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    third = n % 3
    anchor = F.col("text").substr(F.lit(6), F.when(n % 19 == 0, 400).otherwise(30))
    pick = lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), (i + 1).cast("int"))
    return d.select(
        n.alias("id"), pick(golden.FAMILIES, third).alias("familia"), F.upper("source").alias("ticker"), (n % 2 + 2024).alias("fiscal_year"),
        F.when(F.when(third == 0, n % 11 == 0).otherwise(n % 13 != 0), "Revenue").alias("concept_xbrl"), F.when((third != 0) & (n % 5 != 0), F.col("n_chars").cast("double")).alias("cifra_esperada"),
        F.when((third != 0) & (n % 7 != 0), "USD").alias("unidad"), F.when((third != 1) | (n % 17 == 0), pick(("1A", "7", "7A", "8"), n % 4)).alias("item_esperado"),
        F.when(third != 1, anchor).alias("ancla_texto"), F.when(third != 1, F.lit(5).cast("long")).alias("ancla_inicio"), F.when(third != 1, F.length(anchor) + 5 + F.when(n % 23 == 0, 1).otherwise(0)).cast("long").alias("ancla_fin"),
        F.when(n % 29 == 0, F.array(F.lit("catalogo"), F.lit("catalogo"))).otherwise(F.array(F.lit("buscar"), F.lit("leer"))).alias("herramienta_esperada"))


@query(f"""WITH {CASES} SELECT id, array_to_string(list_filter([
CASE WHEN familia <> 'extractiva' AND concept_xbrl IS NULL THEN 'concept_missing' END, CASE WHEN familia <> 'extractiva' AND (cifra_esperada IS NULL) <> (unidad IS NULL) THEN 'number_without_unit' END,
CASE WHEN familia = 'extractiva' AND (concept_xbrl IS NOT NULL OR cifra_esperada IS NOT NULL OR unidad IS NOT NULL) THEN 'number_not_allowed' END,
CASE WHEN familia <> 'numerica' AND (item_esperado IS NULL OR ancla_texto IS NULL OR ancla_inicio IS NULL OR ancla_fin IS NULL) THEN 'anchor_missing' END,
CASE WHEN familia = 'numerica' AND (item_esperado IS NOT NULL OR ancla_texto IS NOT NULL) THEN 'anchor_not_allowed' END,
CASE WHEN len(regexp_split_to_array(trim(ancla_texto), '\\s+')) > 40 THEN 'anchor_too_long' END, CASE WHEN ancla_fin <= ancla_inicio OR ancla_fin - ancla_inicio <> length(ancla_texto) THEN 'anchor_span' END,
CASE WHEN len(list_distinct(herramienta_esperada)) < len(herramienta_esperada) THEN 'tools_repeated' END], lambda x: x IS NOT NULL), ',') AS problems FROM cases""")
def case_problems(spark, sf_dir):
    """What is wrong with each case by itself."""
    return cases(spark, sf_dir).select("id", F.array_join(golden.problems(), ",").alias("problems"))


@query(f"""WITH {CASES}, {V.SECTIONS} SELECT c.id, s.doc_id IS NULL AS section_missing, coalesce(substring(s.texto, c.ancla_inicio + 1, c.ancla_fin - c.ancla_inicio) <> c.ancla_texto, false) AS offsets_wrong FROM cases c LEFT JOIN sections s ON s.doc_id = c.id AND s.item = c.item_esperado""")
def case_vs_corpus(spark, sf_dir):
    """A case's section and anchor in the corpus."""
    s = V.sections(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("item").alias("item_esperado"), "texto")
    j = cases(spark, sf_dir).join(s, ["id", "item_esperado"], "left")
    at = F.col("texto").substr((F.col("ancla_inicio") + 1).cast("int"), (F.col("ancla_fin") - F.col("ancla_inicio")).cast("int"))
    return j.select("id", F.col("texto").isNull().alias("section_missing"), F.coalesce(at != F.col("ancla_texto"), F.lit(False)).alias("offsets_wrong"))


# The same cases against a corpus in which each document is a company, some have a section twice or not at all, and every other one reports.
_CORPUS = f"""{CASES}, {V.SECTIONS}, held AS (SELECT ticker || '.' || doc_id AS ticker, fiscal_year, item, texto FROM sections WHERE doc_id % 31 <> 5 UNION ALL SELECT ticker || '.' || doc_id, fiscal_year, item, texto FROM sections WHERE doc_id % 29 = 4 UNION ALL SELECT ticker || '.' || doc_id, fiscal_year, 'other', '' FROM sections WHERE doc_id % 62 = 5),
reported AS (SELECT upper(source) || '.' || doc_id AS ticker, 2024 + doc_id % 2 AS fiscal_year, 'Revenue' AS concept FROM documents WHERE doc_id % 2 = 0),
placed AS (SELECT * EXCLUDE (ticker), CASE WHEN id % 37 = 8 THEN 'NOWHERE' ELSE ticker || '.' || id END AS ticker, familia = 'numerica' AND cifra_esperada IS NULL AND unidad IS NULL AS absent FROM cases)"""


def _corpus(spark, sf_dir):
    s = V.sections(spark, sf_dir).select("doc_id", F.concat_ws(".", "ticker", "doc_id").alias("ticker"), "fiscal_year", "item", "texto")
    held = s.where("doc_id % 31 <> 5").unionAll(s.where("doc_id % 29 = 4")).unionAll(s.where("doc_id % 62 = 5").withColumn("item", F.lit("other")).withColumn("texto", F.lit("")))
    facts = V.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat_ws(".", F.upper("source"), "doc_id").alias("ticker"), (F.col("doc_id") % 2 + 2024).alias("fiscal_year"), F.lit("Revenue").alias("concept"))
    return cases(spark, sf_dir).withColumn("ticker", F.when(F.col("id") % 37 == 8, "NOWHERE").otherwise(F.concat_ws(".", "ticker", "id"))), held, facts


@query(f"""WITH {_CORPUS}, j AS (SELECT p.*, EXISTS (SELECT 1 FROM held h WHERE h.ticker = p.ticker AND h.fiscal_year = p.fiscal_year) AS there, EXISTS (SELECT 1 FROM reported r WHERE r.ticker = p.ticker AND r.fiscal_year = p.fiscal_year AND r.concept = p.concept_xbrl) AS fact,
 (SELECT count(*) FROM held h WHERE h.ticker = p.ticker AND h.fiscal_year = p.fiscal_year AND h.item = p.item_esperado) AS n, (SELECT min(texto) FROM held h WHERE h.ticker = p.ticker AND h.fiscal_year = p.fiscal_year AND h.item = p.item_esperado) AS texto FROM placed p)
SELECT id, unnest(list_filter([CASE WHEN NOT there AND NOT absent THEN 'document_missing' END, CASE WHEN there AND familia <> 'extractiva' AND NOT fact AND NOT absent THEN 'fact_missing' END, CASE WHEN there AND familia <> 'extractiva' AND fact AND absent THEN 'fact_present' END,
 CASE WHEN there AND familia <> 'numerica' AND n <> 1 THEN printf('sections %d', n) END, CASE WHEN there AND familia <> 'numerica' AND n = 1 AND substring(texto, ancla_inicio + 1, ancla_fin - ancla_inicio) IS DISTINCT FROM ancla_texto THEN 'offsets_wrong' END], lambda x: x IS NOT NULL)) AS problem FROM j""")
def case_corpus_problems(spark, sf_dir):
    """Cases without a document, with a fact missing or present against what they expect, without exactly one section, with a wrong anchor."""
    return golden.corpus_problems(*_corpus(spark, sf_dir))


_ANSWERED = f"""WITH {CASES}, answered AS (SELECT id, familia, cifra_esperada, unidad, CASE WHEN id % 11 = 7 THEN 'timeout' END AS error, CASE WHEN id % 5 = 3 THEN 'texto' WHEN id % 2 = 0 THEN 'ninguna' END AS fuente,
 CASE id % 8 WHEN 0 THEN NULL WHEN 1 THEN cifra_esperada * 1.005::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN cifra_esperada * 1.02::DOUBLE WHEN 4 THEN 'inf'::DOUBLE ELSE cifra_esperada END AS cifra, CASE id % 8 WHEN 0 THEN NULL WHEN 2 THEN CASE WHEN id % 3 = 0 THEN 'USD' END WHEN 5 THEN 'EUR' ELSE ' usd ' END AS unidad_dicha FROM cases)"""


@query(_ANSWERED + """ SELECT id, CASE WHEN familia <> 'extractiva' THEN CASE WHEN familia = 'numerica' AND cifra_esperada IS NULL AND unidad IS NULL THEN coalesce(error IS NULL AND fuente = 'ninguna' AND cifra IS NULL AND unidad_dicha IS NULL, false)
 ELSE coalesce(isfinite(cifra) AND abs(cifra - cifra_esperada) <= 0.01::DOUBLE * greatest(abs(cifra), abs(cifra_esperada)) AND lower(trim(unidad_dicha)) = lower(trim(unidad)), false) END END AS cifra_correcta FROM answered""")
def number_scores(spark, sf_dir):
    """Number and unit, or abstention without error, source, number or unit."""
    n = F.col("id")
    wanted = F.col("cifra_esperada")
    cifra = F.when((n % 8 == 0) | (n % 8 == 2), F.lit(None).cast("double")).when(n % 8 == 1, wanted * 1.005).when(n % 8 == 3, wanted * 1.02).when(n % 8 == 4, float("inf")).otherwise(wanted)
    unit = F.when(n % 8 == 0, F.lit(None).cast("string")).when(n % 8 == 2, F.when(n % 3 == 0, "USD")).when(n % 8 == 5, "EUR").otherwise(" usd ")
    a = cases(spark, sf_dir).select("id", "familia", "cifra_esperada", "unidad", F.when(n % 11 == 7, "timeout").alias("error"), F.when(n % 5 == 3, "texto").when(n % 2 == 0, "ninguna").alias("fuente"), cifra.alias("cifra"), unit.alias("unidad_dicha"))
    return golden.number_scored(a).select("id", "cifra_correcta")


@query(f"WITH {CASES} SELECT id, familia FROM cases WHERE ancla_texto IS NOT NULL AND ancla_texto <> ''")
def anchored_cases(spark, sf_dir):
    """B07."""
    return cases(spark, sf_dir).where("ancla_texto IS NOT NULL AND ancla_texto <> ''").select("id", "familia")


_IDS = (3, 14, 15, 92, 10_000_019)


@query(f"WITH w(id) AS (VALUES {', '.join(f'({i})' for i in _IDS)}), {CASES} SELECT w.id, c.familia, c.id IS NULL AS unknown FROM w LEFT JOIN cases c ON c.id = w.id")
def subset_by_ids(spark, sf_dir):
    """Cases by a list of ids, and which of these are unknown."""
    w = spark.createDataFrame([(i,) for i in _IDS], "id int")
    return F.broadcast(w).join(cases(spark, sf_dir).withColumn("known", F.lit(True)), "id", "left").select(F.col("id").cast("int").alias("id"), "familia", F.col("known").isNull().alias("unknown"))


@query(f"WITH {CASES}, w AS (SELECT item_id * 7 AS id FROM benchmark) SELECT w.id, c.familia, c.id IS NULL AS missing FROM w LEFT JOIN cases c ON c.id = w.id")
def curated_cases(spark, sf_dir):
    """A curated list against the cases, with what is missing."""
    w = V.questions(spark, sf_dir).select((F.col("query_id") * 7).alias("id"))
    c = cases(spark, sf_dir)
    return w.join(c, "id").select("id", "familia", F.lit(False).alias("missing")).unionAll(w.join(c, "id", "left_anti").select("id", F.lit(None).cast("string"), F.lit(True)))


@query(f"""WITH {CASES}, done AS (SELECT event_id AS id, lower({texts.ERROR}) AS low FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0)
SELECT c.id FROM cases c LEFT JOIN done d ON d.id = c.id AND NOT {texts.PASSING} WHERE d.id IS NULL""")
def pending_cases(spark, sf_dir):
    """What isn't finished, or failed in passing."""
    e = V.table(spark, sf_dir, "events").where("event_id % 2 = 0 OR event_id % 3 = 0").select(F.col("event_id").alias("id"), texts.error_of(F.col("event_id")).alias("error"))
    return cases(spark, sf_dir).select("id").join(e.where(~T.transient_error(F.col("error"))), "id", "left_anti")


_COLLECTED = f"WITH {CASES}, collected AS (SELECT id, familia FROM cases UNION ALL SELECT id, familia FROM cases WHERE familia = 'numerica')"


@query(_COLLECTED + """ SELECT id, 'id_repeated' AS problem FROM collected GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT NULL, printf('count %d of %d', count(*), 500) FROM collected HAVING count(*) <> 500
UNION ALL SELECT NULL, printf('comparatives %d of %d', count(*) FILTER (familia = 'comparativa'), 100000) FROM collected HAVING count(*) FILTER (familia = 'comparativa') < 100000""")
def collection_problems(spark, sf_dir):
    """Repeated ids, the expected number of cases, the least number of comparatives."""
    c = cases(spark, sf_dir).select("id", "familia")
    return golden.collection_problems(c.unionAll(c.where("familia = 'numerica'")), 500, 100_000)


@query(f"""WITH {CASES} SELECT id, CASE WHEN familia NOT IN ('extractiva', 'numerica', 'comparativa') THEN 'no_evaluable' WHEN ticker NOT LIKE 'SRC%' THEN 'no_evaluable' WHEN familia <> 'extractiva' AND cifra_esperada IS NULL AND unidad IS NULL THEN 'sin_respuesta' WHEN familia <> 'extractiva' AND cifra_esperada IS NULL THEN 'no_evaluable' ELSE 'golden' END AS tipo FROM cases""")
def holdout_classes(spark, sf_dir):
    """What a case of a lenient file is good for."""
    return cases(spark, sf_dir).select("id", golden.holdout_class(F.col("ticker").like("SRC%")).alias("tipo"))


_HOLD = f"""WITH {CASES}, h AS (SELECT id, CASE WHEN familia <> 'extractiva' AND cifra_esperada IS NULL AND unidad IS NULL THEN 'sin_respuesta' WHEN familia <> 'extractiva' AND cifra_esperada IS NULL THEN 'no_evaluable' ELSE 'golden' END AS tipo, familia, cifra_esperada,
CASE WHEN id % 4 <> 0 THEN cifra_esperada * CASE id % 3 WHEN 1 THEN 1 ELSE 1.02::DOUBLE END END AS cifra FROM cases), s AS (SELECT id, tipo, CASE tipo WHEN 'no_evaluable' THEN NULL WHEN 'sin_respuesta' THEN cifra IS NULL ELSE coalesce(CASE WHEN familia = 'extractiva' THEN true ELSE abs(cifra - cifra_esperada) <= 0.01::DOUBLE * greatest(abs(cifra), abs(cifra_esperada)) END, false) END AS acierto FROM h)"""


def _holdout(spark, sf_dir):
    c = cases(spark, sf_dir).withColumn("tipo", golden.holdout_class(F.lit(True)))
    c = c.withColumn("cifra", F.when(F.col("id") % 4 != 0, F.col("cifra_esperada") * F.when(F.col("id") % 3 == 1, 1.0).otherwise(1.02)))
    right = F.when(F.col("familia") == "extractiva", True).otherwise(N.close(F.col("cifra"), F.col("cifra_esperada"), 0.01))
    return c.withColumn("acierto", F.when(F.col("tipo") == "sin_respuesta", F.col("cifra").isNull()).when(F.col("tipo") == "golden", F.coalesce(right, F.lit(False))))


@query(_HOLD + " SELECT id, tipo, acierto FROM s")
def holdout_scores(spark, sf_dir):
    """Abstention ignores the unit."""
    return _holdout(spark, sf_dir).select("id", "tipo", "acierto")


@query(_HOLD + " SELECT tipo, count(*) FILTER (acierto) || '/' || count(*) AS score, count(*) AS n FROM s GROUP BY 1")
def holdout_summary(spark, sf_dir):
    """D21."""
    return _holdout(spark, sf_dir).groupBy("tipo").agg(F.concat(F.count_if("acierto").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("score"), F.count("*").alias("n"))


# Traces: the calls of each question, paired with their results by id.
_USED = f"WITH {V.TRACE}, used AS (SELECT question_id, list_sort(list_distinct(list(tool))) AS tools FROM trace GROUP BY 1)"


def _used(spark, sf_dir):
    return V.trace(spark, sf_dir).groupBy("question_id").agg(F.sort_array(F.collect_set("tool")).alias("tools"))


@query(_USED + " SELECT question_id, list_has_all(tools, ['click', 'view']) AS correct FROM used")
def trajectory(spark, sf_dir):
    """Expected tools among those used."""
    return _used(spark, sf_dir).select("question_id", (F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), "tools")) == 0).alias("correct"))


@query(_USED + " SELECT question_id, list_has_all(tools, ['click', 'signup']) AS subset, list_contains(tools, 'view') AS evidence_applies FROM used")
def tools_subset(spark, sf_dir):
    """G02, I09."""
    return _used(spark, sf_dir).select("question_id", (F.size(F.array_except(F.array(F.lit("click"), F.lit("signup")), "tools")) == 0).alias("subset"), F.array_contains("tools", "view").alias("evidence_applies"))


@query(f"WITH {V.TRACE}, r AS (SELECT call_id, latency FROM trace WHERE call_id % 10 <> 0) SELECT t.call_id, t.tool, r.latency, CASE WHEN r.call_id IS NULL THEN 'no result' END AS error FROM trace t LEFT JOIN r ON r.call_id = t.call_id")
def trace_pairs(spark, sf_dir):
    """A call without a result is an error."""
    t = V.trace(spark, sf_dir)
    r = t.where("call_id % 10 <> 0").select("call_id", F.col("latency").alias("result"), F.lit(True).alias("there"))
    return t.join(r, "call_id", "left").select("call_id", "tool", F.col("result").alias("latency"), F.when(F.col("there").isNull(), "no result").alias("error"))


# Consulted facts: a purchase event asks for a fact of the segment and year that k names.
_ASKED = f"""{V.FACTS}, {V.TRACE}, segments AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS n FROM (SELECT DISTINCT ticker FROM facts)),
asked AS (SELECT DISTINCT question_id, s.ticker, 1992 + k % 7 AS fiscal_year, CASE WHEN k % 2 = 0 THEN 'Revenue' ELSE 'Quantity' END AS concept FROM trace JOIN segments s ON s.n = k % 5 WHERE tool = 'purchase'),
consulted AS (SELECT question_id, f.* FROM asked a JOIN facts f ON f.ticker = a.ticker AND f.fiscal_year = a.fiscal_year AND f.concept = a.concept)"""


def _consulted(spark, sf_dir):
    f = V.facts(spark, sf_dir)
    # five segments: one task numbers them
    segments = f.select("ticker").distinct().withColumn("n", F.row_number().over(Window.orderBy("ticker")) - 1)
    t = V.trace(spark, sf_dir).where("tool = 'purchase'").withColumn("n", F.col("k") % 5)
    asked = t.join(segments, "n").select("question_id", F.upper(F.trim("ticker")).alias("ticker"), (F.col("k") % 7 + 1992).alias("fiscal_year"), F.when(F.col("k") % 2 == 0, "Revenue").otherwise("Quantity").alias("concept")).distinct()
    return asked.join(f.select("ticker", "fiscal_year", "concept", "value"), ["ticker", "fiscal_year", "concept"])


@query(f"WITH {_ASKED} SELECT question_id, ticker, fiscal_year, concept, value FROM consulted")
def consulted_facts(spark, sf_dir):
    """C11: the facts that a trace asked for, each once."""
    return _consulted(spark, sf_dir).select("question_id", "ticker", "fiscal_year", "concept", "value")


@query(f"WITH {V.CLAIMS} SELECT c.claim_id, count(f.value) AS n_matches FROM claims c LEFT JOIN facts f ON f.ticker = c.ticker AND f.fiscal_year = c.fiscal_year AND abs(c.claimed - f.value) / abs(f.value) <= 0.01::DOUBLE GROUP BY 1")
def claim_any_fact(spark, sf_dir):
    """A claim near any fact of its company and year."""
    return _near_facts(spark, sf_dir).groupBy("claim_id").agg(F.count(F.when(F.col("near"), 1)).alias("n_matches"))


def _near_facts(spark, sf_dir):
    f = V.facts(spark, sf_dir).select("ticker", "fiscal_year", F.col("concept").alias("real_concept"), "value")
    return V.claims(spark, sf_dir).join(f, ["ticker", "fiscal_year"], "left").withColumn("near", F.coalesce(N.within_one_sided(F.col("claimed"), F.col("value"), 0.01), F.lit(False)))


_CLAIMED = f"""WITH {_ASKED}, kinds AS (SELECT *, (length(ticker) + fiscal_year + length(concept)) % 5 AS kind FROM facts),
claims AS (SELECT concat_ws('/', ticker, fiscal_year, concept) AS claim_id, ticker, fiscal_year, concept, unit, kind, CASE kind WHEN 0 THEN value WHEN 1 THEN value * 1.005::DOUBLE WHEN 2 THEN value * 1.05::DOUBLE WHEN 3 THEN round_even(value, 0) ELSE value / 2 END AS claimed FROM kinds),
known AS (SELECT DISTINCT ticker, fiscal_year, concept, value FROM consulted)"""


def _known(spark, sf_dir):
    return _consulted(spark, sf_dir).select("ticker", "fiscal_year", F.col("concept").alias("real_concept"), "value").distinct()


@query(_CLAIMED + " SELECT claim_id FROM claims c WHERE EXISTS (SELECT 1 FROM known k WHERE k.ticker = c.ticker AND k.fiscal_year = c.fiscal_year AND abs(c.claimed - k.value) / abs(k.value) <= 0.01::DOUBLE)")
def claim_consulted(spark, sf_dir):
    """Claims near a consulted fact."""
    j = V.claims(spark, sf_dir).join(_known(spark, sf_dir), ["ticker", "fiscal_year"])
    return j.where(N.within_one_sided(F.col("claimed"), F.col("value"), 0.01)).select("claim_id").distinct()


@query(_CLAIMED + """, m AS (SELECT c.claim_id, f.concept AS real_concept, k.value IS NULL AS unconsulted FROM claims c JOIN facts f ON f.ticker = c.ticker AND f.fiscal_year = c.fiscal_year AND abs(c.claimed - f.value) / abs(f.value) <= 0.01::DOUBLE LEFT JOIN known k ON k.ticker = f.ticker AND k.fiscal_year = f.fiscal_year AND k.concept = f.concept)
SELECT claim_id, real_concept FROM m WHERE unconsulted""")
def claim_unconsulted(spark, sf_dir):
    """Facts that match a claim but weren't consulted."""
    near = _near_facts(spark, sf_dir).where("near")
    return near.join(_known(spark, sf_dir), ["ticker", "fiscal_year", "real_concept"], "left_anti").select("claim_id", "real_concept")


@query(_CLAIMED + """, j AS (SELECT c.claim_id, c.claimed, bool_or(abs(c.claimed - k.value) / abs(k.value) <= 1e-6) AS exact, bool_or(abs(c.claimed - k.value) / abs(k.value) <= 0.01::DOUBLE) AS near, bool_or(k.value <> floor(k.value) AND round_even(k.value, 0) = c.claimed) AS rounded, count(k.value) AS n,
bool_or(abs(c.claimed * 2 - k.value) / abs(k.value) <= 1e-6) AS scaled FROM claims c LEFT JOIN known k ON k.ticker = c.ticker AND k.fiscal_year = c.fiscal_year GROUP BY ALL)
SELECT claim_id, CASE WHEN n = 0 THEN 'nothing_consulted' WHEN exact THEN 'match' WHEN rounded THEN 'rounded' WHEN near THEN 'near' WHEN scaled THEN 'scale' ELSE 'mismatch' END AS verdict FROM j""")
def number_verdict(spark, sf_dir):
    """A claim's verdict against what was consulted."""
    j = V.claims(spark, sf_dir).join(_known(spark, sf_dir), ["ticker", "fiscal_year"], "left")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    c, v = F.col("claimed"), F.col("value")
    a = j.groupBy("claim_id").agg(F.count("value").alias("n"), any_(N.within_one_sided(c, v, 1e-6)).alias("exact"), any_(N.rounded_of(c, v)).alias("rounded"), any_(N.within_one_sided(c, v, 0.01)).alias("near"), any_(N.within_one_sided(c * 2, v, 1e-6)).alias("scaled"))
    return a.select("claim_id", F.when(F.col("n") == 0, "nothing_consulted").when(F.col("exact"), "match").when(F.col("rounded"), "rounded").when(F.col("near"), "near").when(F.col("scaled"), "scale").otherwise("mismatch").alias("verdict"))


# Citations: an answer cites two chunks of its document, the second of which may not be there.
_CITED = f"""WITH {V.CHUNKS}, answers AS (SELECT doc_id, ticker, fiscal_year, item, substring(texto, 21, 60) AS quote, [printf('%s.%d-%d-%s-0000', ticker, doc_id, fiscal_year, item), printf('%s.%d-%d-%s-%04d', ticker, doc_id, fiscal_year, item, doc_id % 4)] AS ids FROM sections WHERE length(texto) > 0),
cited AS (SELECT a.doc_id, a.quote, i.id, c.texto FROM (SELECT *, unnest(list_distinct(ids)) AS id FROM answers) a JOIN (SELECT DISTINCT id FROM (SELECT unnest(ids) AS id FROM answers)) i ON i.id = a.id LEFT JOIN chunks c ON c.chunk_id = a.id)"""


def _answers(spark, sf_dir):
    s = V.sections(spark, sf_dir).where("length(texto) > 0")
    ticker = F.concat_ws(".", "ticker", "doc_id")
    ids = F.array(T.chunk_id(ticker, F.col("fiscal_year"), F.col("item"), F.lit(0)), T.chunk_id(ticker, F.col("fiscal_year"), F.col("item"), F.col("doc_id") % 4))
    return s.select("doc_id", F.substring("texto", 21, 60).alias("quote"), F.array_distinct(ids).alias("ids"))


def _cited(spark, sf_dir):
    c = V.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "texto")
    return _answers(spark, sf_dir).withColumn("id", F.explode("ids")).join(c, "id", "left")


@query(_CITED + " SELECT doc_id, bool_and(texto IS NOT NULL) AS all_exist, count(*) AS n FROM cited GROUP BY 1")
def cited_chunks_all(spark, sf_dir):
    """C14."""
    return _cited(spark, sf_dir).groupBy("doc_id").agg(F.bool_and(F.col("texto").isNotNull()).alias("all_exist"), F.count("*").alias("n"))


_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(_CITED + f" SELECT doc_id, bool_and(texto IS NOT NULL) AS exists_all, coalesce(bool_or(length({_NORM.format('quote')}) > 0 AND contains(replace({_NORM.format('texto')}, 'ß', 'ss'), substring(replace({_NORM.format('quote')}, 'ß', 'ss'), 1, 120))), false) AS supported FROM cited GROUP BY 1")
def citation_support(spark, sf_dir):
    """The cited chunks exist, and one of them has the quote."""
    ok = F.coalesce(T.supported(F.col("quote"), F.col("texto")), F.lit(False))
    return _cited(spark, sf_dir).groupBy("doc_id").agg(F.bool_and(F.col("texto").isNotNull()).alias("exists_all"), F.bool_or(ok).alias("supported"))


@query(_CITED + ", wanted AS (SELECT doc_id, substring(texto, 201, 50) AS quote FROM sections WHERE length(texto) > 250), f AS (SELECT w.doc_id, c.chunk_id FROM wanted w JOIN chunks c ON c.doc_id = w.doc_id AND contains(c.texto, w.quote)) SELECT w.doc_id, CASE WHEN count(f.chunk_id) = 1 THEN max(f.chunk_id) END AS chunk_id FROM wanted w LEFT JOIN f ON f.doc_id = w.doc_id GROUP BY 1")
def citation_relink(spark, sf_dir):
    """A quote's chunk, if it is the only one that has it."""
    w = V.sections(spark, sf_dir).where("length(texto) > 250").select("doc_id", F.substring("texto", 201, 50).alias("quote"))
    j = w.join(V.chunks(spark, sf_dir).select("doc_id", "chunk_id", "texto"), "doc_id", "left").withColumn("chunk_id", F.when(F.contains("texto", F.col("quote")), F.col("chunk_id")))
    return j.groupBy("doc_id").agg(F.when(F.count("chunk_id") == 1, F.max("chunk_id")).alias("chunk_id"))


@query(_CITED + """, said AS (SELECT doc_id, fiscal_year + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS year FROM sections),
e AS (SELECT c.doc_id, array_to_string(list_filter([CASE WHEN bool_or(c.texto IS NULL) THEN 'unknown_chunk' END, CASE WHEN NOT coalesce(bool_or(contains(c.texto, quote)), false) THEN 'not_literal' END, CASE WHEN bool_or(k.fiscal_year <> s.year) THEN 'identity' END], lambda x: x IS NOT NULL), ',') AS errors
FROM cited c JOIN said s ON s.doc_id = c.doc_id LEFT JOIN chunks k ON k.chunk_id = c.id GROUP BY 1) SELECT * FROM e""")
def evidence_errors(spark, sf_dir):
    """Why evidence isn't accepted: no such chunk, not its words, or a chunk of another year than the answer declares."""
    said = V.sections(spark, sf_dir).select("doc_id", (F.col("fiscal_year") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).alias("year"))
    k = V.chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "fiscal_year")
    a = _cited(spark, sf_dir).join(k, "id", "left").join(said, "doc_id").groupBy("doc_id").agg(
        F.bool_or(F.col("texto").isNull()).alias("gone"), F.coalesce(F.bool_or(F.contains("texto", F.col("quote"))), F.lit(False)).alias("literal"), F.coalesce(F.bool_or(F.col("fiscal_year") != F.col("year")), F.lit(False)).alias("other"))
    return a.select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.col("gone"), "unknown_chunk"), F.when(~F.col("literal"), "not_literal"), F.when(F.col("other"), "identity"))), ",").alias("errors"))


@query(f"WITH {V.TRACE}, {texts.ASKED_PLAINLY}, s AS (SELECT DISTINCT question_id FROM trace WHERE tool = 'view') SELECT item_id AS question_id, CASE WHEN NOT {texts.COMPARATIVE} THEN 'not_comparative' WHEN s.question_id IS NULL THEN 'evidence_needed' ELSE 'ok' END AS verdict FROM plain_asks LEFT JOIN s ON s.question_id = item_id")
def comparative_guard(spark, sf_dir):
    """A comparative question needs a search among its calls."""
    asked = texts.asks(spark, sf_dir).select(F.col("item_id").alias("question_id"), T.comparative(F.col("question")).alias("comparative"))
    searched = V.trace(spark, sf_dir).where("tool = 'view'").select("question_id").distinct().withColumn("searched", F.lit(True))
    return asked.join(searched, "question_id", "left").select("question_id", F.when(~F.col("comparative"), "not_comparative").when(F.col("searched").isNull(), "evidence_needed").otherwise("ok").alias("verdict"))


@query(f"""WITH {V.RESULTS} SELECT id, familia = 'numerica' AND cifra IS NULL AND cita IS NULL AND coste IS NOT NULL AS abstained FROM results""")
def abstention(spark, sf_dir):
    """No error, no source, no number."""
    r = V.results(spark, sf_dir)
    return r.select("id", ((F.col("familia") == "numerica") & F.col("cifra").isNull() & F.col("cita").isNull() & F.col("coste").isNotNull()).alias("abstained"))


@query(f"""WITH {V.RESULTS} SELECT id, familia, trayectoria, CASE WHEN familia <> 'numerica' THEN cita END AS cita, CASE WHEN familia <> 'extractiva' THEN cifra END AS cifra, CASE WHEN familia <> 'numerica' THEN recall END AS recall,
trayectoria AND (familia = 'numerica' OR coalesce(cita, true)) AND (familia = 'extractiva' OR coalesce(cifra, true)) AS acierto FROM results""")
def score_cases(spark, sf_dir):
    """All criteria of a case, null where one doesn't apply, and the verdict."""
    r = V.results(spark, sf_dir)
    text, number = F.col("familia") != "numerica", F.col("familia") != "extractiva"
    return r.select(
        "id", "familia", "trayectoria", F.when(text, F.col("cita")).alias("cita"), F.when(number, F.col("cifra")).alias("cifra"), F.when(text, F.col("recall")).alias("recall"),
        (F.col("trayectoria") & (~text | F.coalesce("cita", F.lit(True))) & (~number | F.coalesce("cifra", F.lit(True)))).alias("acierto"))


# Chunks.


@query(f"WITH {V.CHUNKS} SELECT chunk_id, posicion, inicio_car, fin_car, fin_car > inicio_car AND length(texto) = fin_car - inicio_car AS consistent FROM chunks")
def chunk_windows(spark, sf_dir):
    """Overlapping character windows with stable ids and literal text."""
    s = V.sections(spark, sf_dir).withColumn("ticker", F.concat_ws(".", "ticker", "doc_id"))
    c = chunking.character_windows(s, V.CHUNK, V.STEP)
    return c.select("chunk_id", "posicion", "inicio_car", "fin_car", ((F.col("fin_car") > F.col("inicio_car")) & (F.length("texto") == F.col("fin_car") - F.col("inicio_car"))).alias("consistent"))


@query(f"""WITH {V.CHUNKS}, k AS (SELECT * FROM chunks WHERE posicion % 5 <> 3), m AS (SELECT doc_id, inicio_car, max(fin_car) OVER (PARTITION BY doc_id ORDER BY inicio_car ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM k)
SELECT m.doc_id, covered AS gap_from, inicio_car AS gap_to FROM m JOIN sections s ON s.doc_id = m.doc_id WHERE inicio_car > covered AND trim(substring(texto, covered + 1, inicio_car - covered)) <> ''""")
def chunk_gaps(spark, sf_dir):
    """Gaps that aren't blank, in chunks of which some were taken out."""
    c = V.chunks(spark, sf_dir).where("posicion % 5 <> 3")
    return chunking.gaps(c, V.sections(spark, sf_dir).select("doc_id", "texto"))


@query(f"WITH {V.CHUNKS}, n AS (SELECT doc_id, posicion, row_number() OVER (PARTITION BY doc_id ORDER BY inicio_car) - 1 AS place FROM chunks WHERE posicion <> 2 OR doc_id % 2 = 0) SELECT doc_id, bool_and(place = posicion) AS contiguous, count(*) AS n FROM n GROUP BY 1")
def chunk_contiguity(spark, sf_dir):
    """Positions from 0 without holes."""
    return chunking.contiguity(V.chunks(spark, sf_dir).where("posicion <> 2 OR doc_id % 2 = 0"))


@query(f"WITH {V.CHUNKS}, l AS (SELECT doc_id, chunk_id, contiene_tabla, lead(contiene_tabla) OVER w AS next_table, lead(chunk_id) OVER w AS next_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY posicion)) SELECT doc_id, chunk_id, next_id FROM l WHERE contiene_tabla AND next_table")
def adjacent_tables(spark, sf_dir):
    """Neighbours that both hold tables."""
    w = Window.partitionBy("doc_id").orderBy("posicion")
    c = V.chunks(spark, sf_dir).withColumn("next_table", F.lead("contiene_tabla").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))
    return c.where("contiene_tabla AND next_table").select("doc_id", "chunk_id", "next_id")


@query(f"""WITH {V.CHUNKS}, l AS (SELECT c.doc_id, inicio_car, fin_car, length(s.texto) AS total, lag(inicio_car) OVER w AS before, count(*) OVER (PARTITION BY c.doc_id, inicio_car, fin_car) AS same FROM chunks c JOIN sections s ON s.doc_id = c.doc_id WINDOW w AS (PARTITION BY c.doc_id ORDER BY posicion))
SELECT doc_id, bool_and(coalesce(before < inicio_car, true)) AS in_order, max(same) = 1 AS unique_spans, bool_and(fin_car <= total AND inicio_car >= 0) AS in_bounds FROM l GROUP BY 1""")
def cut_validation(spark, sf_dir):
    """E07, K02."""
    return chunking.validate(V.chunks(spark, sf_dir), V.sections(spark, sf_dir).select("doc_id", "texto"))


@query(f"""WITH {V.SECTIONS} SELECT printf('%s.%d-%d-%s-0000', ticker, doc_id, fiscal_year, item) AS chunk_id, n_tokens, contains(texto, '|') AS pipe, contains(texto, chr(9)) AS tab, length(texto) AS fin_car FROM sections""")
def whole_section_chunks(spark, sf_dir):
    """A chunk for each section, with both table flags."""
    s = V.sections(spark, sf_dir).withColumn("ticker", F.concat_ws(".", "ticker", "doc_id"))
    return chunking.whole_sections(s).select("chunk_id", "n_tokens", F.col("contiene_tabla").alias("pipe"), F.contains("texto", F.lit("\t")).alias("tab"), "fin_car")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, greatest(ceil((len(ws) - 16) / 84::DOUBLE), 1)::BIGINT)) AS posicion FROM w WHERE len(ws) > 0)
SELECT doc_id, posicion, len(list_slice(ws, posicion * 84 + 1, posicion * 84 + 100))::BIGINT AS n_words, md5(array_to_string(list_slice(ws, posicion * 84 + 1, posicion * 84 + 100), ' ')) AS digest FROM c""")
def word_window_chunks(spark, sf_dir):
    """Windows of 100 words, 16 of them shared with the next."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("texto"))
    return chunking.word_windows(d, 100, 16).select("doc_id", "posicion", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(f"""WITH {V.CHUNKS} SELECT doc_id, sha256(string_agg(chunk_id || '|' || texto || chr(10), '' ORDER BY posicion)) AS fingerprint FROM chunks GROUP BY 1""")
def fingerprint(spark, sf_dir):
    """A digest of each document's chunks that hangs on order and content (a form of our own)."""
    return chunking.fingerprint(V.chunks(spark, sf_dir))


@query(f"""WITH {V.CHUNKS}, {positions.digest_tree_sql('chunks', 'posicion', "chunk_id || '|' || texto", ['doc_id'])}, digests AS (SELECT doc_id, fingerprint FROM tree) SELECT doc_id, fingerprint FROM digests""")
def fingerprint_tree(spark, sf_dir):
    """A digest of each document's chunks in order, by ranges of positions, so that no document is one string."""
    return positions.digest_tree(V.chunks(spark, sf_dir), "posicion", F.concat("chunk_id", F.lit("|"), "texto"), ["doc_id"])


@query(f"""WITH {positions.digest_tree_sql('documents', 'doc_id', "doc_id || '|' || lang || '|' || text", [])} SELECT fingerprint FROM tree""")
def corpus_fingerprint(spark, sf_dir):
    """One digest of all documents in the order of their ids."""
    return positions.digest_tree(V.table(spark, sf_dir, "documents"), "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text"), [])


@query("""WITH d AS (SELECT row_number() OVER () - 1 AS position, doc_id, n_chars FROM documents), v AS (SELECT row_number() OVER () - 1 AS position, vec_id, label FROM embeddings) SELECT position, doc_id, n_chars, vec_id, label FROM d JOIN v USING (position)""")
def positional_join(spark, sf_dir):
    """Documents and vectors at the same place of their tables, in the order of files and rows."""
    d, v = (positions.positions(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "embeddings"))
    return d.select("position", "doc_id", "n_chars").join(v.select("position", "vec_id", "label"), "position")


@query(f"WITH {V.CHUNKS} SELECT chunk_id, posicion, inicio_car, fin_car, md5(texto) AS digest FROM chunks")
def plugged_chunks(spark, sf_dir):
    """The character windows by a plugged-in cutter."""
    size, step = V.CHUNK, V.STEP

    def windows(text):
        return [(at, min(len(text), at + size)) for at in range(0, max(len(text) - 1 - (size - step), 0) + 1, step)] if text else []

    s = V.sections(spark, sf_dir).withColumn("ticker", F.concat_ws(".", "ticker", "doc_id"))
    return chunking.cut_by(s, windows).select("chunk_id", "posicion", "inicio_car", "fin_car", F.md5("texto").alias("digest"))
